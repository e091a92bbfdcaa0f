"""The training-data operators against brute-force versions on small tables, and on odd rows."""

import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
ODD = [(None, "a b c d e f", "en", None, 1), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 5), (4, "one two", "en", "s", 7), (5, "one two", "en", "s", 7), (5, "one two", "en", "s", 7), (6, LONG, "en", "s", 9), (7, LONG + " end", "en", "t", 9), (8, "ünï 😀   ﬀ 測試 x@y.zz", "xx", "t", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use themselves."""
    docs = spark.createDataFrame(ODD, DOC)
    return docs.withColumns({c: F.lit(c) for c in ("class", "column", "component", "key", "n", "count", "score", "part", "next", "tail", "shard", "rep", "pattern", "label")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, x) for x in r))


# 1 -------------------------------------------------------------------------------------------------------------


def test_tiling_catches_reordered_passages(spark, odd, none):
    from palimpsest.llm.decontaminate import clean, contaminated

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    words = item.split()
    turned = " ".join(["foo"] + words[8:] + ["bar"] + words[:8])
    docs = spark.createDataFrame([(1, f"x y {item.upper()}, z"), (2, turned), (3, " ".join(words[:6])), (4, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (None, "quite another text with some words")], "item_id long, text string")
    found = rows(contaminated(docs, bench), "doc_id", "item_id", "covered_tokens", "n_tiles")
    assert found == [(1, 0, 16, 1), (2, 0, 16, 2)]
    assert found == rows(contaminated(docs, bench, block_mb=0.00005), "doc_id", "item_id", "covered_tokens", "n_tiles")
    assert [r[0] for r in rows(clean(docs, bench), "doc_id")] == [3, 4]
    assert contaminated(odd, bench).count() == 0 and contaminated(none, bench).count() == 0 and contaminated(odd, bench.limit(0)).count() == 0
    assert clean(odd, bench).columns == odd.columns and clean(odd, bench).count() == len(ODD)


def test_tiling_takes_seeds_in_bounded_pieces(spark, monkeypatch):
    """A seed that is in every item, items that repeat, and so few seeds at a time that each document is taken in pieces."""
    from palimpsest.llm import decontaminate as D

    rng = np.random.default_rng(31)
    stock = [" ".join(rng.choice(list("abcdef"), 12)) for _ in range(40)]
    bench = [(i, f"the same four words {stock[i % 13]} end") for i in range(30)]
    docs = [(i, " ".join(["the same four words"] * 6 + [stock[int(j)] for j in rng.integers(0, 40, 4)])) for i in range(12)]
    batch = lambda: iter([__import__("pyarrow").RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in docs])])
    index = D.Index([(i, t.encode()) for i, t in bench], 4)
    all_of = lambda: sorted(tuple(r.values()) for b in D._scan(batch(), index, 0.5) for r in b.to_pylist())
    whole = all_of()
    for n in (1, 7, 50, 400):
        monkeypatch.setattr(D, "SEEDS", n)
        assert all_of() == whole and len(whole) > 10
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert rows(D.contaminated(df, items), "doc_id", "item_id", "covered_tokens") == [(r[0], r[1], r[3]) for r in whole]


def test_tiles_are_greedy():
    from palimpsest.llm.decontaminate import tiles

    rng = np.random.default_rng(3)
    for _ in range(60):
        doc, item = rng.integers(1, 4, 30), rng.integers(1, 4, 14)
        seeds = [(i, j) for i in range(27) for j in range(11) if (doc[i : i + 4] == item[j : j + 4]).all()]
        marked_doc, marked_item, expected = set(), set(), []
        while True:
            best = None
            for j, i in itertools.product(range(14), range(30)):
                n = 0
                while i + n < 30 and j + n < 14 and doc[i + n] == item[j + n] and i + n not in marked_doc and j + n not in marked_item:
                    n += 1
                if n >= 4 and (best is None or n > best[2]):
                    best = (j, i, n)
            if best is None:
                break
            expected.append(best)
            marked_item.update(range(best[0], best[0] + best[2]))
            marked_doc.update(range(best[1], best[1] + best[2]))
        assert sorted(tiles(doc, item, seeds, 4)) == sorted(expected)


# 2 -------------------------------------------------------------------------------------------------------------


def brute_components(data):
    sets = []
    for _, text in data:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(data)))
    for i, j in itertools.combinations(range(len(data)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    ids = {c: min((d for (d, _), k in zip(data, comp, strict=True) if k == c and d is not None), default=None) for c in comp}
    return sorted(((d, len(s), ids[c]) for (d, _), s, c in zip(data, sets, comp, strict=True)), key=lambda r: tuple((x is None, x) for x in r))


def test_jaccard_components(spark, odd, none):
    from palimpsest.llm.jaccard import jaccard_components, one_of_each

    rng = np.random.default_rng(5)
    data = [(None, "a b c d e f"), (900, None), (901, ""), (902, "  "), (903, "Solo"), (904, "solo")]
    for base in range(6):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        for copy in range(14):
            changed = [w if rng.random() > 0.03 * (copy % 4) else f"c{rng.integers(0, 50)}" for w in words]
            data.append((base * 100 + copy, " ".join(changed[: 60 - copy])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(data)
    assert rows(jaccard_components(odd), "doc_id", "n_shingles", "component_id") == brute_components([r[:2] for r in ODD])
    assert jaccard_components(none).count() == 0
    assert one_of_each(odd).columns == odd.columns and {r[0] for r in rows(one_of_each(odd), "doc_id")} == {None, 1, 2, 3, 4, 6, 8}


def test_jaccard_components_of_frequent_columns(spark, monkeypatch):
    """Near copies by the hundred: their columns are cut into blocks, and blocks of the second product into squares."""
    from palimpsest.llm import jaccard

    monkeypatch.setattr(jaccard, "SQUARE", 40)
    rng = np.random.default_rng(15)
    bases = [[f"w{x}" for x in rng.integers(0, 4000, 40)] for _ in range(3)]
    bases.append(bases[0][:32] + [f"z{x}" for x in range(8)])  # shares most of the first one's words
    data = []
    for i in range(900):
        words = list(bases[0 if i % 3 else i % 4])
        for at in rng.integers(0, len(words), i % 3):
            words[at] = f"c{rng.integers(0, 3000)}"
        data.append((int(rng.integers(0, 10**6)) * 1000 + i, " ".join(words)))
    got = rows(jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(data) and 2 < len({r[2] for r in got}) < 800


def test_one_of_each_keeps_one_row(spark):
    from palimpsest.llm.jaccard import one_of_each

    data = [(None, "a b c d e f", "x"), (7, "a b c d e f", "x"), (7, "a b c d e f", "y"), (3, "A B c d e f", "z"), (None, "q r s t u v", "x"), (None, "q r s t u v", "x"), (5, "", "x"), (5, "", "x"), (6, None, "x")]
    assert rows(one_of_each(spark.createDataFrame(data, "doc_id long, text string, k1 string")), "doc_id", "text") == [(3, "A B c d e f"), (5, ""), (5, ""), (6, None), (None, "q r s t u v")]


def test_components(spark):
    from palimpsest.llm.components import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {tuple(r) for r in connected(edges, "a", "b").collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# 3, 6, 8 ---------------------------------------------------------------------------------------------------------


def test_token_records(spark, odd, none):
    from tokenizers import Tokenizer

    from palimpsest.llm.token_records import frame, read_records, read_shard, unframe, write_records

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, start, expected = Tokenizer.from_file(path), 0, []
    for doc_id, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for by_word in (True, False):
        manifest = write_records(odd, path, by_word=by_word, end_id=2)
        assert [tuple(r) for r in read_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()] == expected
    shard = manifest.orderBy("shard").first()
    in_order, shuffled = ([(d, o, x.tolist()) for d, o, x in read_shard(shard["records"], shard["index"], seed)] for seed in (None, 1))
    assert sorted(in_order, key=str) == sorted(shuffled, key=str)
    assert read_records(write_records(none, path, end_id=2)).count() == 0
    assert unframe(io.BytesIO(frame(b"abcd")).read, 0) == b"abcd"
    for at in range(len(frame(b"abcd"))):
        record = bytearray(frame(b"abcd"))
        record[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            unframe(io.BytesIO(bytes(record)).read, 0)


def test_word_encoder_agrees_with_the_library():
    from palimpsest.llm.token_records import TextEncoder

    encoder = TextEncoder(public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    texts = ["It's 3 o'clock, isn't IT?", "x,y ),( ... a.b ,,", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "Ünïcode é é,  nbsp x", "ΣΑΣ ΟΔΟΣ, İ", ""]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, odd, none):
    from tokenizers import Tokenizer, models

    from palimpsest.llm.token_count import MARK, Counter, count_tokens, read_vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = read_vocabulary(path)
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    exact = lambda t: len(library.encode(MARK + t.replace(" ", MARK), add_special_tokens=False).ids) if t else 0
    got = rows(count_tokens(odd, path), "doc_id", "n_tokens")
    assert got == sorted(((r[0], exact(r[1])) for r in ODD), key=lambda r: tuple((x is None, x) for x in r))
    counter = Counter(vocabulary)
    for text in ("a  b \n c", "\n\n x", "☃☃ y\n☃", "<unk>☃ a", "<unk>", "<unk><unk>", "x<unk>\n☃", " <unk> ", "☃<unk>x<unk>", "<unk", "the <unk>\n\n the", "x <s> y", " ", "\t a▁b", "the the  "):
        assert counter(text) == exact(text), text
    # scores with ties, unknown characters that fuse
    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), (MARK, -1.0), (MARK + "a", -2.0)]
    library = Tokenizer(models.Unigram(small, unk_id=0, byte_fallback=False))
    rng, counter = np.random.default_rng(1), Counter(small, byte_fallback=False)
    for _ in range(300):
        text = "".join(rng.choice(list("ab x"), rng.integers(1, 9)))
        assert counter(text) == exact(text), text
    assert count_tokens(none, path).count() == 0


def test_token_counts_of_texts_that_begin_with_a_space():
    from tokenizers import Tokenizer, models

    from palimpsest.llm.token_count import MARK, Counter, read_vocabulary

    vocabulary = read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library, counter = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True)), Counter(vocabulary)
    words = [p.strip(MARK) for p, _ in vocabulary[300::8] if p.strip(MARK)]
    for text in [" foo", " antion", *(f" {w}" for w in words), *(f" {w} the\n{w} x" for w in words[::5])]:
        assert counter(text) == len(library.encode(MARK + text.replace(" ", MARK), add_special_tokens=False).ids), text


def test_packing(spark, odd, none):
    from palimpsest.llm.packing import document_sizes, pack, pack_documents

    rng = np.random.default_rng(2)
    data = [(i, int(rng.integers(1, 60)), int(rng.integers(0, 5)) if rng.random() < 0.5 else None, f"s{rng.integers(0, 3)}") for i in range(300)] + [(300, 250, None, "s0"), (301, 100, 1, None)]
    out = pack(data, 100, 3)
    assert sum(n for _, _, n, *_ in out) == sum(r[1] for r in data)
    bins = {}
    for i, piece, n, b, offset in out:
        bins.setdefault(b, []).append((offset, n, data[i][2] if n < 100 else None, data[i][3] if n < 100 else None, piece))
    for held in bins.values():
        held.sort()
        assert sum(h[1] for h in held) <= 100 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(held))
        clusters = [h[2] for h in held if h[2] is not None]
        assert len(clusters) == len(set(clusters)) and all(sum(h[3] == s for h in held) <= 3 for s in {h[3] for h in held if h[3]})
    # brute force: the tightest compatible bin, the oldest of equals
    state, expected = [], []
    for n, i in sorted(((r[1] % 100, i) for i, r in enumerate(data) if r[1] % 100), key=lambda x: (-x[0], x[1])):
        fits = [(b["room"], k) for k, b in enumerate(state) if b["room"] >= n and (data[i][2] is None or data[i][2] not in b["clusters"]) and b["sources"].count(data[i][3]) < 3]
        k = min(fits)[1] if fits else len(state)
        if not fits:
            state.append({"room": 100, "clusters": [], "sources": []})
        state[k]["room"] -= n
        state[k]["clusters"].append(data[i][2])
        state[k]["sources"].append(data[i][3])
        expected.append((i, n, k))
    whole = sum(r[1] // 100 for r in data)
    assert [(i, n, b - whole) for i, _, n, b, _ in out[whole:]] == expected
    path = public_tokenizers.path("word_bpe_49k.json")
    sizes = document_sizes(odd, path, by_word=True)
    packed = pack_documents(sizes, capacity=64)
    assert packed.agg(F.sum("n_tokens")).first()[0] == sizes.agg(F.sum("n_tokens")).first()[0]
    assert pack_documents(document_sizes(none, path)).count() == 0
    # rows that are all alike are spread over shards like others, and none is lost
    alike = spark.createDataFrame([(1, 7, None, "s")] * 900, "doc_id long, n_tokens long, cluster long, source string")
    packed = pack_documents(alike, capacity=64, shard_rows=100)
    shards = [r["count"] for r in packed.withColumn("shard", F.split("bin", "-")[0]).groupBy("shard").count().collect()]
    assert sum(shards) == 900 and len(shards) >= 8 and max(shards) < 200


# 4, 5 ------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd, none):
    from palimpsest.llm.fingerprint import edits, fingerprint, fingerprints, likeness

    data = [(9, "one two three\nfour five six\n\nseven eight"), (8, "one two three\nfour FIVE six\n\nseven eight"), (7, None), (3, "🙂🙂🙂🙂"), (1, "")]
    got = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    order = sorted(data, reverse=True)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        assert got[doc_id]["n_chars"] == len(text) and got[doc_id]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
    assert got[7]["fingerprint"] == got[1]["fingerprint"] != got[9]["fingerprint"]
    pair = spark.createDataFrame([(data[0][1], data[1][1])], "a string, b string").select(fingerprint(F.col("a")).alias("a"), fingerprint(F.col("b")).alias("b"))
    assert [tuple(x) for x in pair.select(edits(F.col("a"), F.col("b"))).first()[0]] == [(0, 1)]
    assert 0 < pair.select(likeness(F.col("a"), F.col("b"))).first()[0] < 1 and pair.select(likeness(F.col("a"), F.col("a"))).first()[0] == 1
    assert fingerprints(odd).count() == len(ODD) and fingerprints(none).count() == 0


def _brute_fingerprint(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    trees = [[(sha(p), dict.fromkeys(zlib.crc32(w.encode()) for w in re.findall(r"(?:[^\s.!?]+\s+){0,2}[^\s]+", p))) for p in re.split(r"(?<=\n)", s) if p] for s in re.split(r"(?<=\n\n)", text)]
    total, level = sum(len(x) for s in trees for _, x in s), 0
    while total > 256 << level:
        level += 1
    sections = [(sha("".join(d for d, _ in s)), ",".join(f"{d[:16]}:{len(x)}:" + "".join(f"{h:08x}" for h in x if h < 1 << (32 - level)) for d, x in s)) for s in trees]
    return sha("".join(d for d, _ in sections)) + f"{level:02d}|" + "/".join(f"{d[:16]};{x}" for d, x in sections)


def test_fingerprints_are_merkle_trees(spark):
    from palimpsest.llm.fingerprint import fingerprint, likeness

    rng = np.random.default_rng(21)
    words = lambda n: " ".join(rng.choice(["one", "two.", "three", "für", "five!", "six", "7"], n))
    texts = ["", "\n\n", "a\n\n\nb", *("".join(words(int(rng.integers(1, 20))) + str(rng.choice(["\n", "\n\n", " "])) for _ in range(int(rng.integers(1, 9)))) for _ in range(40)), " ".join(f"w{i}" for i in range(9000)), "\n".join(f"w{i} x{i} y z{i}" for i in range(900))]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint(F.col("t")).alias("f")).collect()
    assert all(r["f"] == _brute_fingerprint(r["t"]) for r in made)
    # likeness of texts whose sketches hold all leaves is exact over sets of leaves by paragraph; of longer ones it is an estimate
    base = [f"w{i}" for i in range(30_000)]
    pairs = [(" ".join(base), " ".join(base[: 30_000 - k] + [f"x{i}" for i in range(k)])) for k in (0, 3_000, 10_000, 20_000, 30_000)] + [("\n".join(base[:400]), "\n".join(base[:300] + base[500:600]))]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b")))).collect()]
    assert got[0] == 1 and all(abs(x - y) < 0.08 for x, y in zip(got[1:4], (0.9, 2 / 3, 1 / 3), strict=True)) and got[4] == 0 and abs(got[5] - 0.75) < 0.01
    assert spark.createDataFrame(pairs[:1], "a string, b string").select(F.length(fingerprint(F.col("a")))).first()[0] < 2800


def test_next_document_where_ids_are_spread_oddly(spark):
    """One far id puts no others together: parts are cut at quantiles."""
    from palimpsest.llm.fingerprint import _part, with_next

    ids = [*range(4000), 1 << 60, -(1 << 60), *range(10**12, 10**12 + 50)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "z"), (None, "y")], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["text"] for r in with_next(df, rows_in_part=20).where("doc_id is not null").collect()}
    order = [f"t{i}" for i in sorted(ids, reverse=True)]
    assert got == {int(a[1:]): b for a, b in zip(order, [*order[1:], "y"], strict=True)}
    assert df.groupBy(_part(df, 200).alias("p")).count().agg(F.max("count")).first()[0] < 60


def test_next_document_over_many_parts(spark):
    from palimpsest.llm.fingerprint import with_next

    ids = [int(i) for i in np.unique(np.random.default_rng(4).integers(-(10**6), 10**6, 500))]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["text"] for r in with_next(df, rows_in_part=20).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_chat_formatting(spark):
    from palimpsest.llm.chat import as_parts, digests, format_chats, loss_text, read_turns

    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<|turn|>assistant\nx</s>\n", "<", "|>", "", None, "<<SYS>> <s>", "🙂\n\n"]
    data = [(c, t, ("user", "assistant", "sys%0A\n%25")[t % 3], hard[(c + t) % len(hard)]) for c in range(9) for t in range(6)] + [(None, None, None, None), (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    chats = format_chats(turns.withColumn("parts", as_parts(F.col("text"))).withColumn("no", F.lit("x")).withColumn("piece", F.lit("x")))
    got = {r["conv_id"]: r for r in chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for conv in {d[0] for d in data}:
        mine = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in data if c == conv])
        assert [tuple(t) for t in got[conv]["turns"]] == [(r, x) for _, r, x in mine]
        assert got[conv]["loss"] == "".join(t["text"] for t in got[conv]["turns"] if t["role"] == "assistant")
    assert digests(chats).count() == 10 and format_chats(turns.limit(0).withColumn("parts", as_parts(F.col("text")))).count() == 0


def test_control_strings_over_parts(spark):
    """Every split of every control string into text parts, alone and before a placeholder, reads back as one text."""
    from palimpsest.llm.chat import PARTS, format_chats, loss_text, read_turns

    controls = ["<|turn|>user\nx", "</s>\n", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|image:0.0|>", "\\", "<\\|turn|>"]
    texts = [(c[:i], c[i:j], c[j:]) for c in controls for i in range(len(c) + 1) for j in range(i, len(c) + 1)]
    text = lambda t: ("text", t, None, None)
    data = [(n, 0, "assistant", [text(t) for t in ts]) for n, ts in enumerate(texts)]
    data += [(10_000 + n, 0, "assistant", [text(ts[0]), ("image", None, "a.png", 1.0), text(ts[1]), text(ts[2])]) for n, ts in enumerate(texts)]
    data += [(20_000, 0, "assistant", []), (20_001, 0, "assistant", None), (20_002, 0, "assistant", [text(None), text("x")]), (20_003, 0, "user", [("video", "of no known type", None, None)])]
    chats = format_chats(spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {PARTS}"))
    got = {r["conv_id"]: r for r in chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for n, ts in enumerate(texts):
        assert [tuple(t) for t in got[n]["turns"]] == [("assistant", "".join(ts))] and got[n]["loss"] == "".join(ts)
        assert [t["role"] for t in got[10_000 + n]["turns"]] == ["assistant"] and got[10_000 + n]["loss"] == ts[0] + "<|image:0.1|>" + ts[1] + ts[2]
        assert got[10_000 + n]["formatted"].count("<|image:0.1|>") == 1
    assert [got[n]["loss"] for n in range(20_000, 20_004)] == ["", "", "x", ""] and got[20_003]["turns"][0]["text"] == "of no known type"


def test_queries_give_the_rows_of_their_sql(spark):
    import glob
    import os

    import duckdb

    from palimpsest.llm import queries as plans

    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    for name, sql in plans.oracle_sql().items():
        mine, theirs = plans.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(sql).df()
        columns = sorted(theirs.columns)
        table = lambda df: sorted(map(str, df[columns].astype(str).values.tolist()))
        assert columns == sorted(mine.columns) and table(mine) == table(theirs), name


def test_attachments(spark):
    from palimpsest.llm.chat import PARTS, format_chats

    turns = spark.createDataFrame([(1, 0, "user", [("text", "look <|image:0.0|>", None, None), ("image", None, "a.png", 2.0), ("audio", None, "b.wav", 1.5), ("document", None, "c.pdf", None)])], f"conv_id long, turn long, role string, parts {PARTS}")
    row = format_chats(turns).first()
    assert row["formatted"].endswith("look <\\|image:0.0|><|image:0.1|><|audio:0.2|><|document:0.3|></s>\n")
    assert [(a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 38), ("document", "c.pdf", 768)]


# 7, 9, 10 --------------------------------------------------------------------------------------------------------


def test_html(spark):
    from palimpsest.llm.html_extract import extract_pages, main_text, matching

    page = "<html><head><title>t</title><style>x</style></head><body><header>Site</header><nav><a>m</a></nav><article><h1>Title</h1><p>One &amp; two<br>three<p>Four <b>bold</b> five<div class='comments'><p>nice</p></div><form>f</form><script>1<2</script></article><aside>s</aside><footer>f</footer>"
    assert main_text(page) == "Title\n\nOne & two three\n\nFour bold five"
    assert [main_text(x) for x in ("", "<", "<<p>", "plain", "<p>a</b></div>b<!-- x")] == ["", "<", "<", "plain", "ab"]
    site = [(i, f"https://h.example/{i}", f"<body><div class=top><p>Welcome to the site</p></div><div id=c><h2>Story {i}</h2><p>{'text ' * (i + 5)}{i}</p></div><div class=end><p>All rights kept</p></div>") for i in range(12)]
    odd = [(None, None, None), (20, "x", ""), (21, "https://h.example/z", None), (21, "https://h.example/z", None)]
    got = extract_pages(spark.createDataFrame(site + odd, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("template", F.lit(1)).withColumn("host", F.lit(1)))
    texts = {r["page_id"]: r["text"] for r in got.collect()}
    assert got.count() == 16 and texts[3] == f"Story 3\n\n{'text ' * 8}3" and texts[21] == "" and texts[None] == ""
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert sorted(matching((["r", "a", "b", "c"], [1] * 4, [-1, 0, 0, 0]), (["r", "a", "c"], [1] * 3, [-1, 0, 0]))) == [(0, 0), (1, 1), (3, 2)]


def test_matching_is_a_largest_one():
    from palimpsest.llm.html_extract import _children, matching

    rng = np.random.default_rng(9)

    def tree(n):
        return ["r", *rng.choice(list("ab"), n - 1)], [1] * n, [-1, *(int(rng.integers(max(0, i - 3), i)) for i in range(1, n))]

    def brute(a, b, x, y):
        if a[0][x] != b[0][y]:
            return 0
        ca, cb = _children(a)[x], _children(b)[y]
        best = 0
        for k in range(min(len(ca), len(cb)) + 1):
            for p in itertools.combinations(ca, k):
                for q in itertools.combinations(cb, k):
                    w = [brute(a, b, i, j) for i, j in zip(p, q, strict=True)]
                    best = max(best, sum(w))
        return 1 + best

    for _ in range(60):
        a, b = tree(int(rng.integers(1, 9))), tree(int(rng.integers(1, 9)))
        found = matching(a, b)
        assert len(found) == brute(a, b, 0, 0) and len({x for x, _ in found}) == len({y for _, y in found}) == len(found)
        for x, y in found:
            assert a[0][x] == b[0][y] and (x == y == 0 or (a[2][x], b[2][y]) in found)


def test_html_of_deep_and_long_pages(spark):
    from palimpsest.llm.html_extract import extract_pages, main_text

    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert main_text(deep) == "x" and main_text("<b>" * 5000 + "y") == "y" and main_text("<article>" * 3000 + "z") == "z"
    long = "<article>" + "<p>word word</p><h2>t</h2>" * 400_000 + "</article>"
    pages = [(i, "https://deep.example/", deep if i < 3 else f"<div><p>page {i}</div>") for i in range(14)] + [(99, "https://long.example/", long)]
    got = {r["page_id"]: r for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0]["text"] == "x" and got[9]["text"] == "page 9" and got[99]["n_chars"] == 400_000 * (9 + 2 + 1 + 2) - 2


def test_html_keeps_what_one_word_of_a_class_might_deny(spark):
    from palimpsest.llm.html_extract import extract_pages, main_text

    assert main_text("<article>One</article><aside>no</aside><article>Two two</article>") == "One\n\nTwo two"
    assert main_text('<article><p class="social policy">A</p><div class="share-price">B 12</div><p class="notice">C</p><math>x</math><label>D</label></article>') == "A\n\nB 12\n\nC\n\nx D".replace("x D", "xD")
    drop = ['<div class="share-bar">s</div>', '<ul class="related"><li>r</li></ul>', '<section id="comments"><p>nice</p></section>', '<article class="comment">c</article>', '<div class="ad slot-7">buy</div>', '<p class="advert">buy</p>', '<div class="notice">n</div>', "<form><label>l</label></form>", '<div class="share-price"><a>see prices</a></div>', '<div role="search">q</div>', "<nav>m</nav>", '<div class="widget newsletter">w</div>', '<div class="user-comments"><p>nice</p></div>', '<div class="related-stories">r</div>', '<ol class="commentlist"><li>c</li></ol>']
    assert [main_text(f"<article><p>Text</p>{d}</article>") for d in drop] == ["Text"] * len(drop)
    assert main_text('<div class="sidebar-left"><article><p>Text</p></article></div>') == "Text"
    # what every page of a host has, under a class that may say so, is none of an article; what varies is
    page = lambda i, said: f'<body><article><h1>Story {i}</h1><p>{"text " * 9}{i}</p><div class="share price">{said}</div></article>'
    site = [(i, "https://a.example/", page(i, "Tell all your friends")) for i in range(14)] + [(100 + i, "https://b.example/", page(i, f"It is at {i}")) for i in range(14)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(site, "page_id long, url string, html string")).collect()}
    assert all(("friends" not in got[i]) and got[100 + i].endswith(f"It is at {i}") for i in range(14))


def test_html_of_hosts_without_articles(spark):
    """Exact texts of hosts whose layouts mark nothing: their template is all that tells text from the rest."""
    from palimpsest.llm.html_extract import extract_pages

    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    layouts = {
        "tables.example": "<table><tr><td>Home | News | Shop</td></tr><tr><td><h2>{h}</h2>{b}</td><td>Our address: Long Street 7</td></tr></table><center>All rights kept</center>",
        "divs.example": "<div id=x1><p>Welcome to these pages</p></div><div id=x2><div><h1>{h}</h1>{b}</div></div><div id=x3><p>Call us on weekdays</p><p>Terms of use</p></div>",
        "plain.example": "<p>The daily page</p><h1>{h}</h1>{b}<p>Printed on paper made of trees</p>",
    }
    pages, expected = [], {}
    for host, layout in layouts.items():
        for _ in range(25):
            h, b = words(4), [words(int(rng.integers(8, 60))) for _ in range(int(rng.integers(1, 6)))]
            expected[len(pages)] = "\n\n".join([h, *b])
            pages.append((len(pages), f"https://{host}/{len(pages)}", layout.format(h=h, b="".join(f"<p>{x}</p>" for x in b))))
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    right = {host: sum(got[i] == expected[i] for i, u, _ in pages if host in u) for host in layouts}
    assert right == {"tables.example": 25, "divs.example": 25, "plain.example": 25}


def test_html_of_near_copies_and_odd_first_pages(spark):
    from palimpsest.llm.html_extract import extract_pages, templates

    story = "<h1>One story</h1><p>The first long paragraph of it.</p><p>A second one.</p>"
    near = [(i, f"https://{host}/{i}", f"<body><div class=top><p>Welcome to the site</p></div>{a}{story}<p>Day {i}</p>{b}<div class=end><p>All rights kept</p></div>") for host, a, b, at in (("tag.example", "<article>", "</article>", 0), ("plain.example", "<div id=c>", "</div>", 100)) for i in range(at, at + 20)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(near, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        whole = f"One story\n\nThe first long paragraph of it.\n\nA second one.\n\nDay {i}"
        assert text == whole if i < 100 else whole in text, (i, text)
    # a marked article keeps what all articles of a host have in common
    same = [(i, f"https://s.example/{i}", f"<body><article><h1>Story {i}</h1><p>{'text ' * 9}{i}</p><p>Said in all of them.</p></article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith("Said in all of them.") for i in range(12))
    page = lambda i: f"<body><div class=top><p>Welcome to the site</p></div><div id=c><h2>Story {i}</h2><p>{'text ' * (i + 5)}{i}</p></div><div class=end><p>All rights kept</p></div>"
    firsts = ("", None, "<table><tr><td>another layout</table>")
    site = [(100 * h + i, f"h{h}", page(i) if i else firsts[h]) for h in range(3) for i in range(13)]
    found = {r["key"]: r["template"] for r in templates(spark.createDataFrame(site, "key long, host string, html string")).collect()}
    assert sorted(found) == [100 * h + i for h in range(3) for i in range(1, 13)] and all(len(t) >= 2 for t in found.values())


def test_base_spans():
    from palimpsest.llm.pii import KINDS, base_spans, luhn

    def brute(text):
        found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda s: re.sub("[^0-9]", "", s)
        found += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))

    rng = np.random.default_rng(6)
    for text in ["a@b.c.@d.e x@@y.z", "1.2.3.4.5.6.7.8 0001.2.3.4", "4111 1111 1111 1111-2 +1((((9", *("".join(rng.choice(list("a.@+1 20-(5)4"), 60)) for _ in range(2000))]:
        assert base_spans(text) == brute(text), text


def test_personal_data(spark, odd, none):
    from palimpsest.llm.pii import find_personal_data, redact

    data = [(i, f"some words mail{i}@host.example.org and +1 (212) 555-01{i:02d} or 10.0.0.{i} card 4111 1111 1111 1111 end", "en", "s", 1) for i in range(40)] + [(100, "call me (212) 555-0199 today", "en", "s", 1), (101, "on 2024-05-06 it cost 199.95", "en", "s", 1)]
    docs = spark.createDataFrame(data, DOC)
    got = {r["doc_id"]: r for r in find_personal_data(docs).collect()}
    assert all(got[3][f"n_{k}"] == 1 for k in ("email", "ip", "card", "phone")) and got[100]["spans"] == "phone:8:22" and got[101]["spans"] == ""
    assert got[101]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert redact(docs).where("doc_id = 100").first()["text"] == "call me [PHONE] today"
    assert find_personal_data(odd).count() == len(ODD) and find_personal_data(none).count() == 0 and redact(odd).columns == odd.columns


def test_field_chooses_the_best_segmentation():
    """Against every segmentation of short windows; and its likelihoods against their sums."""
    from palimpsest.llm.pii import KINDS, Field, span_features, train, windows

    field = train([f"some words mail{i}@host.example.org and +1 (212) 555-01{i:02d} or 10.0.0.{i} card 4111 1111 1111 1111 end" for i in range(12)])
    rng = np.random.default_rng(4)

    def segmentations(tokens, i=0):
        if i == len(tokens):
            yield []
            return
        for rest in segmentations(tokens, i + 1):
            yield [(i, i + 1, None), *rest]
        for j in range(i + 1, len(tokens) + 1):
            names = span_features(tokens, i, j)
            if names is not None:
                for kind in range(len(KINDS)):
                    if (kind == 0) == (names[0] == "address"):
                        for rest in segmentations(tokens, j):
                            yield [(i, j, kind), *rest]

    def score(tokens, parts):
        total, last = 0.0, 0
        for i, j, kind in parts:
            label = 0 if kind is None else kind + 1
            total += field.moves[last, label]
            total += field.outside[Field._plain(tokens[i])] if kind is None else sum(field.w[field.index[n], kind] for n in span_features(tokens, i, j) if n in field.index)
            last = label
        return total

    texts = ["call (212) 555 0199", "a@b.org", "4111/1111 x", "at x dot y", "+1 555 12", *(" ".join(rng.choice(["212", "555-0199", "x", "at", "@", "dot", "y.org", "+1"], 3)) for _ in range(25))]
    seen = 0
    for text in texts:
        for tokens in windows(text):
            if len(tokens) <= 7:
                best = max(segmentations(tokens), key=lambda p: score(tokens, p))
                got = [(i, j, k) for i, j, k in field.best(tokens)]
                inside = {i for a, b, _ in got for i in range(a, b)}
                parts = sorted(got + [(i, i + 1, None) for i in range(len(tokens)) if i not in inside], key=lambda p: p[0])
                assert abs(score(tokens, parts) - score(tokens, best)) < 1e-6, text
                seen += 1
    assert seen > 15


def test_field_finds_forms_of_texts_it_has_not_seen(spark):
    """Held-out precision and recall of the added spans by kind: other forms of base matches, and look-alikes, of documents that it wasn't trained on."""
    import random

    from palimpsest.llm.pii import _variants, all_spans, base_spans, train

    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 20000").orderBy("doc_id").select("text").collect() if base_spans(r[0])]
    field, rng = train(texts[::2]), random.Random(99)
    found, asked, wrong = ({k: 0 for k in ("email", "card", "phone", "ip")} for _ in range(3))
    for text in texts[1::2]:
        for s, e, kind in base_spans(text):
            for form, real in _variants(kind, text[s:e], rng):
                made, a, b = text[max(0, s - 80) : s] + form + text[e : e + 60], min(s, 80), min(s, 80) + len(form)
                if form == text[s:e] or any(x < b and a < y for x, y, _ in base_spans(made)):
                    continue
                hits = [(x, y, k) for x, y, k in all_spans(made, field)[1] if x < b and a < y]
                asked[kind] += real
                found[kind] += real and (a, b, kind) in hits
                wrong[kind] += bool(hits) and (not real or (a, b, kind) not in hits)
    assert all(asked[k] - found[k] <= max(1, 0.1 * asked[k]) for k in asked) and all(wrong[k] <= 0.1 * max(asked[k], 10) for k in wrong) and sum(asked.values()) > 20, (found, asked, wrong)


def test_label_model_against_enumerated_posteriors():
    from palimpsest.llm.toxicity import VOTERS, bits, fit_label_model

    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.15
    rates = np.where(np.arange(VOTERS) % 3 == 0, 0.5, 0.2)
    votes = rng.random((4000, VOTERS)) < np.where(y[:, None], rates, 0.01)
    patterns = votes @ (1 << np.arange(VOTERS))
    values, counts = np.unique(patterns, return_counts=True)
    model = fit_label_model(values, counts.astype(float), (patterns[:400], y[:400].astype(float)))
    assert np.abs(model.rates[1] - rates).max() < 0.12 and np.abs(model.rates[0] - 0.01).max() < 0.02
    x = bits(values)
    for row, p in zip(x[:50], model.posterior(x[:50]), strict=True):  # Bayes' rule, a voter at a time
        odds = model.prior / (1 - model.prior)
        for v, vote in enumerate(row):
            one, zero = (model.rates[c][v] if vote else 1 - model.rates[c][v] for c in (1, 0))
            odds *= (one / zero) ** model.weights[v]
        assert abs(p - odds / (1 + odds)) < 1e-9
    assert np.mean((model.posterior(bits(patterns)) > 0.5) == y) > 0.97


def test_personal_data_of_other_forms(spark):
    from palimpsest.llm.pii import _variants, find_personal_data, redact, windows

    names = ["jane", "max.mustermann", "a_b-c.d", "mary.lou_smith-jones"]
    hosts = ["example.org", "mail.example.co.uk", "my-host.example.org"]
    data = [(i, f"some words {names[i % 4]}@{hosts[i % 3]} and +1 (212) 555-01{i:02d} or 10.0.0.{i} card 4111 1111 1111 1111 end", "en", "s", 1) for i in range(40)]
    forms = [(f"{n} at {h.replace('.', ' dot ')}", "email") for n in names for h in hosts] + [(f"{n} [at] {h}", "email") for n in names for h in hosts]
    forms += [(sign.join(["4111", "1111", "1111", "1111"]), "card") for sign in (".", "  ", "/")]
    forms += [(x, "phone") for x in ("(212) 555-0199", "212-555-0199", "212.555.0199", "(212) 555 0199", "212 555 0199")]
    rng = __import__("random").Random(2)
    for value, kind in (("jane@example.org", "email"), ("4111 1111 1111 1111", "card"), ("+1 212 555 0199", "phone")):
        forms += [(x, kind) for _ in range(30) for x, real in _variants(kind, value, rng) if real and x != value]
    plain = ["we met at noon by the dot on the map", "look at this [at] all", "at home"]
    asked = [(1000 + i, f"they wrote {x} and then left", "en", "s", 1) for i, (x, _) in enumerate(forms)] + [(3000 + i, x, "en", "s", 1) for i, x in enumerate(plain)]
    for _, text, *_ in asked:
        assert all(a[1] <= b[0] and not text[a[1] : b[0]].strip() for w in windows(text) for a, b in itertools.pairwise(w)), text
    docs = spark.createDataFrame(data + asked, DOC)
    spans = {r["doc_id"]: r["spans"] for r in find_personal_data(docs).collect()}
    assert [(x, spans[1000 + i]) for i, (x, _) in enumerate(forms)] == [(x, f"{k}:11:{11 + len(x)}") for x, k in forms]
    assert [spans[3000 + i] for i in range(len(plain))] == [""] * len(plain)
    texts = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert all(texts[1000 + i] == f"they wrote [{k.upper()}] and then left" for i, (_, k) in enumerate(forms))


def test_toxicity(spark, odd, none):
    from palimpsest.llm.toxicity import scored, without_toxic

    rng = np.random.default_rng(8)
    data, labels = [], []
    for i in range(1200):
        words, toxic = [f"w{x}" for x in rng.integers(0, 400, 40)], rng.random() < 0.2
        if toxic:
            words[rng.integers(0, 40)] = f"grumpf{rng.integers(0, 30)}"
        data.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, labels_df = spark.createDataFrame(data, DOC), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in scored(docs, labels_df).collect()}
    held = [i for i, *_ in labels if got[i]["held_out"]]
    assert held == [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) > 0.97
    assert without_toxic(docs, labels_df).count() == sum(not r["predicted"] for r in got.values())
    assert scored(odd, labels_df).count() == len(ODD) and scored(none, labels_df).count() == 0 and scored(odd, labels_df.limit(0)).count() == len(ODD)
    assert without_toxic(odd, labels_df).columns == odd.columns


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_query_op1(spark, documents):
    """Every pair of a document and an item, with seeds by brute force."""
    from palimpsest.llm.decontaminate import tiles, tokens
    from palimpsest.llm.queries import op1_decontamination

    items = {r["item_id"]: tokens((r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = []
    for doc_id, text in documents.items():
        words = tokens(text.encode())
        places = {}
        for i in range(len(words)):
            places.setdefault(tuple(words[i : i + 4]), []).append(i)
        for item_id, item in items.items():
            k = min(4, len(item))
            seeds = [(i, j) for j in range(len(item) - k + 1) for i in (places.get(tuple(item[j : j + 4]), []) if k == 4 else [i for i in range(len(words)) if words[i : i + k] == item])]
            if k and seeds:
                covered = sum(t[2] for t in tiles(np.array(words, object), np.array(item, object), seeds, k))
                if 2 * covered >= len(item):
                    expected.append((doc_id, item_id, len(item), covered))
    assert rows(op1_decontamination(spark, SF), "doc_id", "item_id", "item_tokens", "covered_tokens") == sorted(expected)


def test_query_op3(spark, documents):
    from tokenizers import Tokenizer

    from palimpsest.llm.queries import op3_token_records

    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc_id in sorted(documents):
        ids = [*tokenizer.encode(documents[doc_id], add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(op3_token_records(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_query_op4(spark, documents):
    from palimpsest.llm.queries import op4_fingerprints

    order, expected = sorted(documents, reverse=True), []
    for doc_id, after in zip(order, order[1:] + order[:1], strict=True):
        text = documents[doc_id]
        k = len(text) // 3
        edited = text[: len(text) - k] + documents[after][:k]
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), _brute_fingerprint(text), _brute_fingerprint(edited)))
    got = op4_fingerprints(spark, SF)
    assert rows(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint") == sorted(expected)
    assert 0.55 < got.agg(F.avg("near_edited")).first()[0] < 0.75 and got.agg(F.avg("near_next")).first()[0] < 0.1


def test_query_op6(spark, documents):
    from tokenizers import Tokenizer, models

    from palimpsest.llm.queries import op6_token_counts
    from palimpsest.llm.token_count import MARK, read_vocabulary

    library = Tokenizer(models.Unigram(read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), unk_id=0, byte_fallback=True))
    count = lambda t: len(library.encode(MARK + t.replace(" ", MARK), add_special_tokens=False).ids) if t else 0
    assert rows(op6_token_counts(spark, SF), "doc_id", "n_tokens") == sorted((i, count(t)) for i, t in documents.items())


def test_query_op7(spark):
    """The given pages mark one article each, of headings and paragraphs."""
    import html

    from palimpsest.llm.queries import op7_html_extraction

    expected = []
    for page_id, source in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect():
        blocks = re.split(r"</?(?:h[1-6]|p|div|ul|li|blockquote)\b[^>]*>", re.search(r"<article[^>]*>(.*?)</article>", source, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " ")).split()) for b in blocks]
        expected.append((page_id, "\n\n".join(b for b in blocks if b)))
    got = op7_html_extraction(spark, SF)
    assert rows(got, "page_id", "text") == sorted(expected) and got.where("n_chars <> length(text)").count() == 0


def test_query_op8(spark, documents):
    from tokenizers import Tokenizer

    from palimpsest.llm.queries import op8_best_fit_packing

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes, bins = {}, {}
    for r in op8_best_fit_packing(spark, SF).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["bin"], []).append((r["offset"], r["n_tokens"]))
    assert sizes == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in documents.items()}
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(held)) and sum(n for _, n in held) <= 8192


def test_query_op9(spark, documents):
    from palimpsest.llm.pii import luhn
    from palimpsest.llm.queries import op9_personal_data

    kinds = ("email", "ip", "card", "phone")
    digits = lambda s: re.sub("[^0-9]", "", s)
    expected = []
    for doc_id, text in documents.items():
        found = [(m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [(m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [(m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        found += [(m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
        found.sort(key=lambda x: (x[0][0], kinds.index(x[1])))
        written = [f"{k}:{s}:{e}" for (s, e), k in found]
        expected.append((doc_id, *(sum(k == kind for _, k in found) for kind in kinds), hashlib.sha256(",".join(written).encode()).hexdigest(), set(written)))
    got = sorted(tuple(r) for r in op9_personal_data(spark, SF).select("doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans").collect())
    assert [r[:6] for r in got] == [r[:6] for r in sorted(expected)] and all(b[6] <= set(a[6].split(",")) for a, b in zip(got, sorted(expected), strict=True))


def test_query_op10(spark, documents):
    """Folds, ranges, and that scores are what learning left: held-out rows are told apart by labels that no score has seen."""
    from palimpsest.llm.queries import op10_toxicity

    got = op10_toxicity(spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in documents}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    score = {documents[r["doc_id"]]: r["score"] for r in got}
    assert all(abs(r["score"] - score[documents[r["doc_id"]]]) < 1e-12 for r in got)  # equal texts are scored alike
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for fold in (True, False):
        one, zero = ([r["score"] for r in got if r["held_out"] == fold and labels.get(r["doc_id"]) == v] for v in (1, 0))
        pairs = [(a > b) + (a == b) / 2 for a in one for b in zero]
        assert not pairs or sum(pairs) / len(pairs) > 0.75  # the few toxic rows of the held-out fold here give 0.80


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with planted toxic texts, copies, benchmark items and personal data, and the odd rows; a folder with its labels and benchmark."""
    rng = np.random.default_rng(77)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 900, n)]
    item = " ".join(f"b{i}" for i in range(30))
    data, labels = [], []
    for i in range(400):
        text = words(50)
        if i % 8 == 0:
            text[int(rng.integers(0, 50))] = f"grumpf{i % 5}"
        if i % 40 == 7:
            text += item.split()
        if i % 10 == 3:
            text += [f"mail{i}@host.example.org", "or", "+1 (212) 555-0134"]
        if i % 25 == 4 and i > 25:
            text = data[i - 21][1].split()[:-1] + ["changed"]
        data.append((i + 100, " ".join(text), "en", f"s{i % 4}", 1))
        labels.append((i + 100, 1, int(i % 8 == 0)))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.createDataFrame(data + ODD, DOC), folder, item


def _plain(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_stage_toxicity(spark, corpus):
    """What was planted goes and all else stays, odd rows too: no score of the model has a part in what is expected."""
    import corpus_pipeline

    docs, folder, _ = corpus
    expected = [r for r in _plain(docs) if not re.search("grumpf[0-4]", r[1] or "")]
    assert _plain(corpus_pipeline.toxicity(spark, docs, folder)) == expected and len(docs.collect()) - len(expected) == 50


def test_stage_near_duplicates(spark, corpus):
    import corpus_pipeline

    docs, folder, _ = corpus
    data = _plain(docs)
    ids = [r[2] for r in brute_components([(i, r[1]) for i, r in enumerate(data)])]  # by place
    groups = {}
    for r, group in zip(data, ids, strict=True):
        groups.setdefault(group, []).append(r)
    kept = _plain(corpus_pipeline.near_duplicates(spark, docs, folder))
    smallest = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()]
    assert sorted(map(str, (r[0] for r in kept))) == sorted(map(str, smallest)) and set(kept) <= set(data) and len(kept) < len(data) - 10


def test_stage_decontamination(spark, corpus):
    import corpus_pipeline

    docs, folder, item = corpus
    expected = [r for r in _plain(docs) if item not in (r[1] or "")]
    assert _plain(corpus_pipeline.decontamination(spark, docs, folder)) == expected and len(expected) == 400 + len(ODD) - 10


def test_stage_personal_data(spark, corpus):
    """By the regular expressions of the base rules, as the corpus holds no other forms (one odd text has an address without a dot in its name)."""
    import corpus_pipeline

    docs, folder, _ = corpus
    expected = []
    for doc_id, text, lang, source, _ in docs.collect():
        if text:
            text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
            text = re.sub(r"\+[0-9][ ().0-9-]+[0-9]", lambda m: "[PHONE]" if 9 <= sum(c.isdigit() for c in m[0]) <= 15 else m[0], text)
        expected.append((doc_id, text, lang, source, None if text is None else len(text)))
    got = corpus_pipeline.personal_data(spark, docs, folder)
    assert got.schema == docs.schema and _plain(got) == sorted(expected, key=lambda r: tuple((x is None, x) for x in r))
    assert sum("[EMAIL] or [PHONE]" in (r[1] or "") for r in expected) == 40


def plain_packing(rows, capacity=8192, most=8):
    """Bins as lists of (doc_id, n) by trying every bin: rows (doc_id, n, words, source) in order."""
    full, left = [], []
    for i, (doc_id, n, *_) in enumerate(rows):
        full += [[(doc_id, capacity)]] * (n // capacity)
        left += [(n % capacity, i)] * (n % capacity > 0)
    bins = []
    for n, i in sorted(left, key=lambda x: (-x[0], x[1])):
        doc_id, _, words, source = rows[i]
        fits = [(capacity - sum(h[1] for h in b), k) for k, b in enumerate(bins) if capacity - sum(h[1] for h in b) >= n and not (words and any(h[2] == words for h in b)) and sum(h[3] == source for h in b) < most]
        if not fits:
            bins.append([])
        bins[min(fits)[1] if fits else -1].append((doc_id, n, words, source))
    return full + [[h[:2] for h in b] for b in bins]


def _bins(bins):
    return sorted((sorted(b, key=str) for b in bins), key=str)


def _sized(docs):
    """(doc_id, tokens with the end, words, source) of rows (doc_id, text, source)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1, (t or "").lower().split(), s) for i, t, s in docs]


def test_stage_packing(spark, corpus):
    """Every bin against trying all bins, in the order of ids: sizes by the library, rows of equal words apart, at most eight of a source."""
    import corpus_pipeline

    docs, folder, _ = corpus
    rows = sorted(_sized([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    placed, bins = corpus_pipeline.packing(spark, docs, folder).collect(), {}
    for r in placed:
        bins.setdefault(r["bin"], []).append((r["offset"], r["doc_id"], r["n_tokens"]))
    for held in bins.values():
        held.sort(key=lambda h: h[0])
        assert held[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in itertools.pairwise(held))
    assert _bins([h[1:] for h in held] for held in bins.values()) == _bins(plain_packing(rows))


def test_stages_on_empty_and_odd_tables(spark, corpus, odd, none):
    import corpus_pipeline

    _, folder, _ = corpus
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == none.columns and stage(spark, odd, folder).columns == odd.columns, name


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "n_tokens", "bin", "offset"] and out.count() > 100
