"""op9 on forms that the tables don't hold: names and hosts of any kind, numbers that are nobody's, dense texts."""

import time

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

LOCALS, HOSTS = ("jane", "bob.smith", "j_doe", "mary42", "the.65"), ("example.org", "acme.com", "mail7.example.com", "my-host.co.uk")
BARE = (lambda n, h: f"{n} at {h.replace('.', ' dot ')}", lambda n, h: f"{n} at {h.replace('.', ' dot ')}".upper())
BRACKETED = (lambda n, h: f"{n} [at] {h}", lambda n, h: f"{n} (at) {h.replace('.', ' (dot) ')}")
NOBODYS = (
    "2024 12 31 23 59", "DOI 10.1000 182 2024 77 12", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "0 36000 29145 2", "978-3-16-148410-0", "1 2 3 4 5 6 7 8 9 10 11 12",
    "2024-12-31 23:59:59", "3.14 2.71 1.41 1.61 0.57", "version 10.2.33", "meet at noon dot", "look at the dot com crash", "12 345 678 901 234", "2023-01-05", "100 200 300 400 500", "192-168-0-1", "300.400.500.600",
)


@pytest.fixture(scope="module")
def field():
    from palimpsest.llm.pii import train

    texts = duckdb.sql("SELECT DISTINCT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE length(text) < 20000 AND regexp_matches(text, '[0-9]@|@[a-z]|\\+[0-9]|[0-9]{12}|[0-9]\\.[0-9]+\\.[0-9]') ORDER BY text LIMIT 300").fetchall()
    return train([t for (t,) in texts])


def found(field, form, kind):
    from palimpsest.llm.pii import all_spans

    text = f"Please write to {form} before noon."
    return any(text[s:e] == form and k == kind for s, e, k in all_spans(text, field)[1])


def test_emails_in_words(field):
    for forms, least in ((BARE, 34), (BRACKETED, 38)):
        asked = [f(n, h) for n in LOCALS for h in HOSTS for f in forms]
        missed = [a for a in asked if not found(field, a, "email")]
        assert len(asked) - len(missed) >= least, missed


def test_numbers_of_other_forms(field):
    assert all(found(field, n, "phone") for n in ("(415) 555-2671", "415-555-2671", "415.555.2671", "415 555 2671"))
    assert all(found(field, n, "card") for n in ("4111.1111.1111.1111", "4111/1111/1111/1111", "4111  1111  1111  1111"))


def test_what_is_nobodys(field):
    from palimpsest.llm.pii import all_spans, base_spans

    taken = []
    for form in NOBODYS:
        text = f"We noted {form} in the report."
        taken += [text[s:e] for s, e, k in all_spans(text, field)[1] if (s, e, k) not in base_spans(text)]
    assert len(taken) <= 1, taken


def test_dense_texts_take_time_in_proportion(field):
    from palimpsest.llm.pii import all_spans

    for unit in ("1.", "1 ", "a at b dot c ", "123 456 789 "):
        all_spans(unit * 200, field)
        took = []
        for n in (2000, 8000):
            began = time.time()
            all_spans(unit * (n // len(unit)), field)
            took.append(time.time() - began)
        assert took[1] < 8 * took[0] + 0.5 and took[1] < 15, (unit, took)


def test_scores_by_shape_are_those_of_features(field):
    """What is remembered for a shape is the score of each candidate that has it."""
    import numpy as np

    from palimpsest.llm import pii as P

    rng = np.random.default_rng(9)
    parts = ["212", "555-0199", "x", "at", "@", "dot", "y.org", "+1", "10.0.0.1", "300.1.2.3", "4111 1111 1111 1111", "4111 1111 1111 1112", "Tel", "mail:", "[at]", "é", "("]
    for _ in range(150):
        text = " ".join(rng.choice(parts, 8))
        for tokens in P.windows(text):
            plain = {}
            for i in range(len(tokens)):
                for j in range(i + 1, min(len(tokens), i + P.LONGEST) + 1):
                    names = P.span_features(tokens, i, j)
                    if names is not None:
                        plain[i, j] = field.w[[field.index[n] for n in names if n in field.index]].sum(0) + P._ONLY[names[0]]
            got = {(i, j): v for j, (starts, values) in enumerate(field.scored(tokens)) for i, v in zip(starts, values, strict=True)}
            assert got.keys() == plain.keys() and all(np.allclose(got[k], plain[k]) for k in plain), text
