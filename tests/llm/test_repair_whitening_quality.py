"""op11 to op13 against plain Python, on odd rows and empty tables; op3 against the library over all Unicode categories."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

TURNS = "conv_id long, turn long, role string, text string"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, x) for x in r))


# 3 -------------------------------------------------------------------------------------------------------------


def test_words_of_all_categories_are_encoded_as_the_library_does():
    from palimpsest.llm.token_records import TextEncoder

    rng = np.random.default_rng(7)
    kinds = defaultdict(list)
    for c in range(0x110000):
        if unicodedata.category(chr(c)) not in ("Cs", "Cn"):
            kinds[unicodedata.category(chr(c))].append(chr(c))
    names = sorted(kinds)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick("abcXYZéü") if rng.random() < 0.5 else pick("!?.,;()'-_%#<|09") if rng.random() < 0.5 else pick(kinds[pick(names)]) for _ in range(rng.integers(1, 7)))
    plain = ["the", "river", "bank", "km²,", "x²)", "½cup,", "IIⅣ.", "long", "don't"]
    texts = [" ".join(word() if rng.random() < 0.3 else pick(plain) for _ in range(rng.integers(1, 12))) for _ in range(6000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    by_word, whole = TextEncoder(path, True), TextEncoder(path, False)
    for at in range(0, len(texts), 1000):  # in company of other words
        part = [t.encode() for t in texts[at : at + 1000]]
        assert [x.tolist() for x in by_word.encode(part)] == [x.tolist() for x in whole.encode(part)]


def test_a_count_of_word_ends_that_is_off_is_not_used(monkeypatch):
    from palimpsest.llm import token_records as T

    monkeypatch.setattr(T, "_MARKED", re.compile(r"(\D+)[!-/]+"))
    path = public_tokenizers.path("word_bpe_49k.json")
    by_word = T.TextEncoder(path, True)
    whole = T.TextEncoder(path, False)
    monkeypatch.setattr(by_word, "ends", np.ones_like(by_word.ends))
    texts = [b"the river bank, was very quiet today", b"encyclopaedia, of rivers"]
    assert [x.tolist() for x in by_word.encode(texts)] == [x.tolist() for x in whole.encode(texts)]


# 11 ------------------------------------------------------------------------------------------------------------


def plain_repair(turns):
    """The cheapest edits by dynamic programming over the output's end, as whole lists: rows (turn, role, text) after damage, in order."""
    count, illegal, seen, marked = Counter(), 0, set(), []
    for i, (_, role, text) in enumerate(turns):
        shown = text.strip(WHITE)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        if i and turns[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
            illegal += 1
        marked.append((role, text, fault))
    best = {"": (0, "", ())}  # what was written last

    def inserted(best):
        for _ in range(3):
            for end, (cost, audit, made) in list(best.items()):
                x = "a" if end == "u" else "u"
                new = (cost + 3, audit + "I", (*made, ("user:" if x == "u" else "assistant:")))
                if x not in best or new[:2] < best[x][:2]:
                    best[x] = new
        return best

    for role, text, fault in marked:
        after = {}

        def offer(end, new, after=after):
            if end not in after or new[:2] < after[end][:2]:
                after[end] = new

        for end, (cost, audit, made) in inserted(dict(best)).items():
            offer(end, (cost + 4, audit + "D", made))
            if fault in ("", "truncated"):
                more, x = 3 * (fault != ""), "a" if end == "u" else "u"
                if role[:1] == x or role[:1] == "s" and end == "":
                    offer(role[:1], (cost + more, audit + "K", (*made, f"{role}:{text}")))
                offer(x, (cost + more + 3, audit + "R", (*made, f"{'user' if x == 'u' else 'assistant'}:{text}")))
        best = after
    cost, audit, made = min(x for end, x in inserted(best).items() if end in ("", "a"))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def plain_damage(table):
    out = defaultdict(list)
    for conv_id, turn, role, text in table:
        of = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{of(conv_id)}:{of(turn)}".encode()) % 20, of(role), of(text)
        out[conv_id]  # noqa: B018
        if kind:
            text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
            out[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x)) for c, r in out.items()}


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_is_the_cheapest_one(spark):
    from palimpsest.llm.chat_repair import damaged, repair_report

    rng = np.random.default_rng(11)
    roles, texts = ["user", "assistant", "system", "tool", "usr", "", None], ["Yes.", "No!", "and then", " \x0b", "", None, "Ünï 😀?", "a\r\nb. \n"]
    table = [(int(c), int(t), roles[int(rng.choice(7, p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05]))], texts[int(rng.integers(8))] if rng.random() < 0.4 else f"text {rng.integers(9)}.") for c in range(300) for t in range(rng.integers(1, 9))]
    table += [(1, None, "user", "Null turn."), (1, None, "assistant", "Another."), (None, 3, "user", "No id."), (None, 5, "assistant", "None."), (2, 1, "user", "twice."), (2, 1, "user", "twice.")]
    table += [(900, t, "assistant" if t % 2 else "user", f"long {t}.") for t in range(400)] + [(901, t, "user", " ") for t in range(60)] + [(902, 0, "system", "S.")] + [(902, t, "user", "") for t in range(1, 40)]
    df = spark.createDataFrame(table, TURNS).withColumns({c: F.lit(c) for c in ("fault", "initial", "nth", "copy", "kind", "is_row")})
    expected = sorted(((c, *plain_repair(r)) for c, r in plain_damage(table).items()), key=lambda r: tuple((x is None, x) for x in r))
    assert rows(repair_report(damaged(df), df), *REPORT) == expected
    assert any(r[7] == "" for r in expected) and any("I" in r[7] and "R" in r[7] for r in expected)


def test_repaired_turns_alternate(spark):
    from palimpsest.llm.chat_repair import repair_report, repaired_turns

    table = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (1, 3, "assistant", "C."), (2, 0, "assistant", "x"), (3, 0, "system", "S."), (3, 1, "tool", "T."), (3, 2, "assistant", "Z.")]
    df = spark.createDataFrame(table, TURNS)
    made = rows(repaired_turns(df), "conv_id", "place", "edit", "role", "text")
    assert [r for r in made if r[0] == 3] == [(3, 0, "K", "system", "S."), (3, 1, "R", "user", "T."), (3, 2, "K", "assistant", "Z.")]
    for c, cost in ((1, 7), (2, 4), (3, 3)):
        kept = [r for r in made if r[0] == c and r[1] is not None]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[3][0] for r in kept)) and [r[1] for r in kept] == list(range(len(kept)))
        assert rows(repair_report(df).where(F.col("conv_id") == c), "cost") == [(cost,)]
    empty = df.limit(0)
    assert repair_report(empty, empty).count() == 0 and repaired_turns(empty).count() == 0
    none = rows(repair_report(empty, df), *REPORT)
    assert none == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2, 3)]


def test_repair_holds_few_rows_of_a_long_conversation():
    from palimpsest.llm.chat_repair import Repair

    rng, parse, waiting, made = np.random.default_rng(3), Repair(), 0, 0
    for _ in range(20_000):
        made += len(list(parse.add((b"user", b"assistant", b"system", b"tool")[rng.integers(4)], b"text", ("", "", "truncated", "blank")[rng.integers(4)])))
        waiting = max(waiting, len(parse.waiting))
    assert waiting < 200 and made + len(list(parse.end())) >= 20_000


def test_query_op11(spark, tmp_path):
    from palimpsest.llm.queries import queries

    table = [(c, t, ("user", "assistant")[t % 2], f"Text {c} {t}.") for c in range(40) for t in range(5)]
    spark.createDataFrame(table, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = rows(queries()["op11_conversation_repair"](spark, str(tmp_path)), *REPORT)
    assert found == sorted((c, *plain_repair(r)) for c, r in plain_damage(table).items())


# 12 ------------------------------------------------------------------------------------------------------------

WHITENED = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def plain_whitening(vectors, k=8):
    """(deviations, projections, explained) by exact fractions and numpy's eigh."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    off = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [sum(v * v for v in r) for r in off], np.array([[float(Fraction(v, n)) for v in r] for r in off]) @ (u / np.sqrt(e)), e / np.trace(cov)


@pytest.mark.parametrize("scale", [0.1, 900.0])
def test_whitening_of_odd_rows(spark, scale):
    from palimpsest.llm.whitening import whitened

    rng = np.random.default_rng(12)
    good = (rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10)) * scale + 3).tolist()
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], [1e300] + good[0][1:], [], good[0][:9]]
    table = [(i, v) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, good[5]), (7, good[7])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("v", "n", "pos", "component")}).repartition(5)
    deviation, projected, explained = plain_whitening([*good, good[5], good[7]])
    found = rows(whitened(df), *WHITENED)
    ids = [*range(300), None, 7]
    expected = {(i, k + 1): (deviation[at], projected[at, k], explained[k]) for at, i in enumerate(ids) for k in range(8)}
    assert len(found) == 302 * 8 and {r[:2] for r in found} == set(expected)
    sign = {k + 1: np.sign(next(r[4] for r in found if r[:2] == (0, k + 1)) * projected[0, k]) for k in range(8)}
    for i, c, n, dev, w, share, error in found:
        assert n == 302 and dev == (expected[i, c][0] if expected[i, c][0] < 1 << 63 else None) and abs(w * sign[c] - expected[i, c][1]) < 1e-9 and abs(share - expected[i, c][2]) < 1e-12 and error < 1e-10


def test_whitening_of_few_and_equal_vectors(spark):
    from palimpsest.llm.whitening import whitened

    of = lambda t: spark.createDataFrame(t, "vec_id long, embedding array<float>")
    assert whitened(of([])).count() == 0 and whitened(of([(1, None)])).count() == 0
    assert whitened(of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance, no component
    line = rows(whitened(of([(1, [1.0, 2.0]), (2, [3.0, 4.0])])), "vec_id", "component", "explained")
    assert [r[:2] for r in line] == [(1, 1), (2, 1)] and abs(line[0][2] - 1) < 1e-12


def test_polarisation_is_exact_beyond_longs():
    from palimpsest.llm import whitening as W

    y = np.array([[1 << 50, -(1 << 50), 3], [5, 7, 11]])
    assert W._squares(y).tolist() == [2 * (1 << 100) + 9, 25 + 49 + 121, ((1 << 50) + 5) ** 2 + (7 - (1 << 50)) ** 2 + 14**2]
    values = np.array([-(1 << 100), 1 << 120, -1, 0], object)
    assert [sum(v.as_py() << 32 * k for k, v in enumerate(x)) for x in zip(*W._limbs(values), strict=True)] == values.tolist()


# 13 ------------------------------------------------------------------------------------------------------------

COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_counts(text):
    text = text or ""
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def corpus():
    rng = np.random.default_rng(13)
    stock = ["river", "bank", "was", "quiet", "The", "after", "heavy", "rain", "and", "nobody", "walked", "there", "of", "it", "München", "été."]
    text = lambda n, end="": " ".join(str(rng.choice(stock)) + end for _ in range(n))
    docs = [(i, text(int(rng.integers(25, 300))), ("en", "de", None)[i % 3], ("a", "b")[i % 2], 1) for i in range(900)]
    junk = [(1000 + i, text(80, "###" if i % 2 else "!!").upper() if i % 2 == 0 else text(80, "###"), ("en", "de", None)[i % 3], ("a", "b")[i % 2], 1) for i in range(60)]
    copies = [(2000 + i, docs[3][1], "en", "b", 1) for i in range(700)]
    odd = [(None, docs[0][1], None, None, 1), (3000, None, "en", "a", None), (3001, "", "en", "a", 0), (3002, "\n\n \x0b\n", "en", "a", 0), (3003, "one two\none two\n" * 30, "en", "a", 0), (3004, "a b c d e f g h i a b c d e f g h", "xx", "rare", 0), (3005, text(30_000), "en", "a", 0)]
    return docs + junk + copies + odd


def test_quality_counts_and_outliers(spark):
    from palimpsest.llm.quality import judged

    table = corpus()
    df = spark.createDataFrame(table, DOC).withColumns({c: F.lit(c) for c in ("keys", "start", "q0", "level", "e", "group", "step", "n", "kept")})
    found = rows(judged(df), *COUNTS, "kept", "distance")
    assert [r[:7] for r in found] == rows(spark.createDataFrame([(i, *plain_counts(t)) for i, t, *_ in table], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"), *COUNTS)
    assert all((r[8] is None) == r[6] and not (r[6] and r[7]) for r in found)
    kept = {r[0] for r in found if r[7]}
    assert not kept & set(range(1000, 1060)) and set(range(900)) - kept == {r[0] for r in found if r[0] is not None and r[0] < 900 and r[6]}
    assert judged(df.limit(0)).count() == 0


def plain_mcd(vectors, share, noise, step_limit=12):
    """The estimate of one group: the same two starts and concentration steps over all vectors at once."""
    from palimpsest.llm import quality as K

    q = np.array(vectors, float) / K.UNIT
    solve = lambda mean, s: (mean, K.CONSISTENT * s + noise)
    med = np.median(q, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(q - med), axis=0), np.sqrt(np.diag(noise)))
    unit = (q - med) / scale
    long = np.sqrt((unit**2).sum(axis=1, keepdims=True))
    signs = np.round(K.UNIT * np.divide(unit, long, out=np.zeros_like(unit), where=long > 0)) / K.UNIT
    best = None
    for s in (np.diag(scale**2), K.P * (signs.T @ signs / len(q)) * np.outer(scale, scale)):
        mean, full = solve(med, s)
        before = None
        for _ in range(step_limit):
            off = q - mean
            d = np.einsum("ni,ij,nj->n", off, np.linalg.inv(full), off)
            step = np.floor(16 * np.log2(np.maximum(d, 1e-6)))
            limit = np.sort(step)[int(np.ceil(share * len(q))) - 1]
            part = q[step <= limit]
            mean, full = solve(part.mean(axis=0), np.cov(part.T, bias=True))
            logdet = np.linalg.slogdet(full)[1]
            if before is not None and abs(before - logdet) < 1e-9:
                break
            before = logdet
        if best is None or logdet < best[0] - 1e-9:
            best = logdet, mean, full
    return best


def test_estimates_are_those_of_plain_concentration(spark):
    from palimpsest.llm import quality as K
    from palimpsest.llm.shared import Scratch

    stats = K.statistics(spark.createDataFrame(corpus(), DOC))
    found = {(r["keys"]["lang"], r["keys"]["source"]): r for r in K.estimates(stats, Scratch(spark)).collect()}
    groups = defaultdict(set)
    for r in stats.where("not base_failed").collect():
        v = tuple(r[f"q{i}"] for i in range(K.P))
        for key in ((r["lang"], r["source"]), (r["lang"], "*"), ("*", "*")):
            groups[key].add(v)
    groups = {k: v for k, v in groups.items() if len(v) >= K.LEAST or k[0] == "*"}
    assert set(found) == set(groups) and ("*", "*") in groups and len(groups) >= 7
    for key, vectors in groups.items():
        logdet, mean, _ = plain_mcd(sorted(vectors), K.SHARE, K.NOISE)
        assert abs(found[key]["logdet"] - logdet) < 1e-6 and np.allclose([found[key][f"m{i}"] for i in range(K.P)], mean, atol=1e-6)


def test_chi_squared():
    from palimpsest.llm.quality import chi2_at, chi2_below

    # fixed values: chi-squared quantiles as printed in tables
    for p, freedom, x in ((0.95, 1, 3.841459), (0.99, 7, 18.475307), (0.975, 10, 20.483177), (0.5, 4, 3.356694)):
        assert abs(chi2_at(p, freedom) - x) < 1e-5 and abs(chi2_below(x, freedom) - p) < 1e-6


def test_repeated_words():
    from palimpsest.llm.quality import repeated_words

    rng = np.random.default_rng(4)
    for n in (0, 7, 8, 9, 30, 200, 1000):
        for kinds in (1, 2, 3, 40):
            words = [str(x).encode() for x in rng.integers(0, kinds, n)]
            words += words[3:20] * (n == 1000)
            assert repeated_words(words) == plain_counts(" ".join(w.decode() for w in words))[4]
