"""Places that tests need; a module of its own, since several folders have a conftest."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata"
