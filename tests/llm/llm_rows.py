"""Documents with every kind of edge, and helpers of the tests."""

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names the operators use inside or for results.
CLASHES = ("row", "h", "score", "lang_pred", "number", "size", "cls", "node", "n_lines", "n_removed", "piece_ids", "kept", "i", "s")


def words(n, start=0, stem="wort"):
    return " ".join(f"{stem}{(start + 7 * i) % 9973}" for i in range(n))


def edge_rows():
    long_run = words(60, 5, "lauf")
    short_lines = "\n".join(f"{words(20, 40 * k, 'zeile')}" for k in range(4))
    copy = words(200, 11, "kopie")
    near = " ".join([*copy.split()[:-3], "ganz", "anderes", "ende"])
    rows = [
        (1, "The quick brown fox. It jumps, it runs!", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", "b"),
        (4, " \n\t\r\v\f ", "de", None),
        (5, "12345 !!! ???", None, "b"),
        (6, "wort", "de", "b"),
        (7, "wort", "de", "c"),
        (8, "x" * 50_000, "en", "c"),
        (9, words(30_000), "de", "c"),
        (10, long_run + "\nallein " + words(30, 3, "eins"), "de", None),
        (11, "davor\n" + long_run + "\ndanach", "de", "a"),
        (12, short_lines, "de", "a"),
        (13, "kopf\n" + short_lines + "\nfuß", "de", "d"),
        (14, copy, "de", "d"),
        (15, copy, "de", "d"),
        (16, near, "de", "a"),
        (17, copy.upper(), "de", "a"),
        (18, "été à l'école  où▁est\n\nl'élève ? 日本語 \U0001f600  \u0085x", "fr", "z"),
        (19, "mail a.b@c-d.org and x@y@z.com, 10.0.0.300 10.0.0.30, +49 (30) 1234-567 card 4111 1111 1111 1111 DE89 3704 0044 0532 0130 00", "en", "z"),
        (None, "ohne nummer " + words(20, 77), "de", "z"),
        (None, copy, "de", "z"),
        (20, words(40, 1, "paar"), "de", "z"),
        (20, words(40, 2000, "anders"), "de", "z"),
        (21, "gleich " + words(25, 9, "zwei"), "de", "z"),
        (21, "gleich " + words(25, 9, "zwei"), "de", "z"),
        (22, " ".join(["immer"] * 40), "de", "z"),
        (23, "\n".join(["dieselbe zeile"] * 30), "de", "z"),
        (-5, "<|endoftext|> 'S İstanbul. É. don't", "en", "z"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
