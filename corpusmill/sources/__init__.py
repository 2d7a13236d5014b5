"""Readers and writers: crawl lines, HTML files, archives, shards."""
