SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, keep boolean, h long, rep long, spans string, place int, shard int, f0 long"
LONG = "a very long text of plain words. " * 40_000


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), 7, "k", 0.5, True, 1, 2, "x", 3, 4, 5)


ROWS = [
    row(1, "the quick brown fox jumps over the lazy dog and runs away from the old house by the river"),
    row(2, "the quick brown fox jumps over the lazy dog and runs away from the old house by the river"),
    row(3, None, None),
    row(4, ""),
    row(5, " \n\t "),
    row(6, "?!…"),
    row(7, LONG),
    row(8, "Ünïcödé wörds: straße, naïve café — ‘quoted’ 漢字 🙂\x00 end", "de"),
    row(9, "word"),
    row(9, "word"),
    row(10, "one text of a repeated id"),
    row(10, "another text of the same id"),
    row(None, "a row without any id"),
    row(None, None),
    (11, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    row(-5, 'he wrote token = "0123456789abcdef0123456789abcdef" there'),
]
