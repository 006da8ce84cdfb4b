"""Tables inside texts against Python's own reader, on planted tables of all dialects."""

import csv
import io
import random

from tidemill.operators.privacy import csvtext as C

NAMES = [("full_name", "PERSON_NAME"), ("email", "EMAIL_ADDRESS"), ("note", None), ("phone", "PHONE_NUMBER"), ("n", None)]


def planted(rng):
    """(text, the typed values in order)."""
    columns = rng.sample(NAMES, rng.randint(2, 5))
    if not any(k for _, k in columns):
        columns[0] = NAMES[0]
    delimiter = rng.choice(C.DELIMITERS)
    word = lambda: "".join(rng.choice("ab c,;|\t\"\n'é1") for _ in range(rng.randint(0, 9))).strip(" \t")
    rows = [[word() for _ in columns] for _ in range(rng.randint(1, 6))]
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerow([n for n, _ in columns])
    w.writerows(rows)
    typed = [(k, v) for r in rows for (_, k), v in zip(columns, r) if k and v]
    return out.getvalue(), typed


def test_planted_tables():
    rng = random.Random(8)
    for _ in range(400):
        parts, want = [], []
        for _ in range(rng.randint(1, 3)):
            table, typed = planted(rng)
            parts.append(rng.choice(["Some prose here.\n\n", "Dear all\n", ""]) + table + "\n")
            want += typed
        text = "".join(parts)
        got = [(k, text[a:b].replace('""', '"')) for a, b, k in C.values(text)]
        assert got == want, text


def test_no_table():
    for text in ["", "a, b and c\nmore, of it\n", "email, phone\n", "email,phone\n\nnothing", 'email,note\n"open,quote\nx,y', "name email\nx y\n", "email;note\na;b;c\n", "x,y\n1,2\n", "|||\n|||\n", "," * 5000]:
        assert C.values(text) == [], text
    assert C.values("email,note\na@x.org,b\nc@x.org,d,e\nf@x.org,g\n") == [(11, 18, "EMAIL_ADDRESS")]


def test_frame(spark):
    df = spark.createDataFrame([(1, 'see\nemail;city\n"a@x.org";Bonn\n'), (None, "email,n\nb@x.org,2"), (3, None), (4, "no table")], "id long, text string")
    got = sorted(((r.id, r.start, r.end, r.type, r.value) for r in C.csv_values(df, "id").collect()), key=repr)
    assert got == sorted([(1, 16, 23, "EMAIL_ADDRESS", "a@x.org"), (1, 25, 29, "CITY", "Bonn"), (None, 8, 15, "EMAIL_ADDRESS", "b@x.org")], key=repr)
