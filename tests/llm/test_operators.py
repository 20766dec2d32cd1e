"""The training-data operators against brute force, on rows with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import block_naming, bpe, chunk_bpe, common, cutting_stock, gru_lm, line_dedup, near_dedup, range_coder, substring_dedup, token_files, topk_search, toxicity

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row string, h long, node string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts() -> list:
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    line = lambda n=9: " ".join(r.choice(words) for _ in range(n))
    block = "\n".join(line() for _ in range(12))
    base = [line(80) for _ in range(6)]
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(base[0].split())) for k in (3, 40, 70)]
    out = [None, "", " \n\t ", "one", "one two three four", "Ünïcode — 日本語\x85 x  y", "a<|endoftext|> b", "it's we'll", "x" * 3000, "\n\n\n"]
    out += base + near + [base[1], base[1] + " ", base[1].upper(), base[2].replace(" ", "\n")]
    out += [f"{line(20)} {passage} {line(20)}", f"{line(5)} {passage}", passage, f"{passage} {line(3)} {passage}"]
    out += [f"{line()}\n{block}\n{line()}", f"{line()}\n{line()}\n{block}", f"{block}\n{block}"]
    out += [line(r.randint(1, 300)) for _ in range(10)] + [line(9000)]
    return out


def rows() -> list:
    texts = some_texts()
    out = [(i * 3, t, "en", "s", len(t or ""), "clash", "clash", 1, "clash") for i, t in enumerate(texts)]
    out += [(None, texts[12], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), out[13], out[13]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique_docs(spark):
    return spark.createDataFrame(rows()[:-4], SCHEMA).repartition(3)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (line_dedup.op1(empty), token_files.op2(empty, WORD), chunk_bpe.digests(empty, BYTE), block_naming.op4(empty), cutting_stock.pack(empty, WORD), topk_search.op6(vectors), toxicity.op7(empty, labels), substring_dedup.op8(empty), gru_lm.op9(empty), near_dedup.op10(empty)):
        assert out.count() == 0
    for out in (line_dedup.dedup_lines(empty), near_dedup.keep_one(empty), substring_dedup.dedup_substrings(empty), toxicity.keep_clean(empty, labels)):
        assert out.columns == empty.columns and out.count() == 0


def line_chunks(text: str) -> list:
    lines = text.split("\n")
    h = [0, 0, *(int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines)]
    out, held = [], []
    for i, x in enumerate(lines):
        held.append(x)
        if (h[i + 2] + 3 * h[i + 1] + 9 * h[i]) % 4 == 0:
            out.append(held)
            held = []
    return out + [held] * bool(held)


def test_line_dedup(spark):
    docs = unique_docs(spark)
    got = {r["doc_id"]: r for r in line_dedup.op1(docs).collect()}
    seen, removed = set(), 0
    for doc_id, text, *_ in rows()[:-4]:
        kept, gone = [], 0
        for c in line_chunks(text or ""):
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
                continue
            if len(c) > 1:
                seen.add(tuple(c))
            kept += c
        removed += gone
        assert got[doc_id]["kept_sha256"] == sha("\n".join(kept)) and got[doc_id]["n_removed_lines"] == gone
    assert removed > 10
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_token_files(spark, docs, tmp_path):
    path = token_files.write(docs, str(tmp_path / "set"), WORD, 1, files=3, block_ids=1000)
    got = token_files.documents(spark, path).collect()
    tok = Tokenizer.from_file(WORD)
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    want = Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t, *_ in rows() for x in [ids(t)])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    runs = token_files.read(spark, path).orderBy("file", "ordinal", "part").collect()
    assert sum(r["n_ids"] for r in runs) == sum(len(r["ids"]) for r in runs) and max(r["part"] for r in runs) > 3


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_range_coder(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 500, n), np.zeros(n, int), np.arange(n) % 7, np.minimum(r.geometric(0.01, n), 49000)):
        block = range_coder.encode(ids.astype(np.uint32), 49408)
        assert range_coder.decode(block).tolist() == ids.tolist()
        if n > 60:
            with pytest.raises(ValueError):
                range_coder.decode(block[:-4])
            broken = bytearray(block)
            broken[-20] ^= 255
            try:
                assert range_coder.decode(bytes(broken)).tolist() == ids.tolist()
            except ValueError:
                pass
    assert len(range_coder.encode(np.zeros(5000, np.uint32), 49408)) < 1200


#: Checksums of blocks that this coder's first version wrote.
WRITTEN = {49408: 494676906, 131072: 1446140938}


@pytest.mark.parametrize("alphabet", [49408, 1 << 17])
def test_range_coder_writes_the_same_blocks(alphabet):
    r = np.random.default_rng(9)
    ids = np.minimum(r.geometric(0.003, 70_000), 40_000).astype(np.uint32)
    ids[30_000:50_000] = ids[:20_000]
    block = range_coder.encode(ids, alphabet)
    assert (range_coder.decode(block) == ids).all()
    assert zlib.crc32(block) == WRITTEN[alphabet]  # blocks written earlier stay readable


def test_chunk_bpe(spark, docs):
    tok = Tokenizer.from_file(BYTE)
    got = Counter(tuple(r) for r in chunk_bpe.digests(docs, BYTE).collect())
    want = Counter()
    for d, t, *_ in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    back = chunk_bpe.decode(chunk_bpe.encode(docs, BYTE), BYTE)
    assert Counter(tuple(r) for r in back.collect()) == Counter((d, t or "") for d, t, *_ in rows())


def test_chunks_are_shared():
    r = random.Random(1)
    shared = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000))
    texts = pa.array([f"{'x' * k} {shared}" for k in range(0, 50, 5)])
    store = chunk_bpe.ChunkStore(BYTE)
    bounds, data = common.offsets_of(texts)
    ids, at = store.encode(data, bounds)
    tok = Tokenizer.from_file(BYTE)
    assert all(ids[at[i] : at[i + 1]].tolist() == tok.encode(t).ids for i, t in enumerate(texts.to_pylist()))
    assert store.encoded < 3 * 2000 * 6 / 512 + 30  # not ten times as many


def test_chunk_joins_grow_until_they_agree(monkeypatch):
    r = random.Random(3)

    def unsafe(data):  # any place where a character starts, one in five
        out = ((data & 0xC0) != 0x80) & (np.random.default_rng(0).random(len(data)) < 0.2)
        out[:1] = False
        return out

    monkeypatch.setattr(bpe, "hard_boundaries", unsafe)
    store, tok = chunk_bpe.ChunkStore(BYTE), Tokenizer.from_file(BYTE)
    for _ in range(5):
        words = ["".join(r.choice("abcdefgh éß'日\n.,") for _ in range(r.randint(1, 9))) for _ in range(300)]
        held = [" ".join(r.choice(words) for _ in range(r.randint(0, 900))) for _ in range(20)]
        bounds, data = common.offsets_of(pa.array(held))
        ids, at = store.encode(data, bounds)
        assert all(ids[a:b].tolist() == tok.encode(t).ids for t, a, b in zip(held, at, at[1:], strict=False))
    assert store.repaired > 50


def test_cores_of_chunks_are_encoded_from_pieces_met_before():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghéßÀ") for _ in range(r.randint(3, 9))) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(5000)) for _ in range(4)]
    store, tok, sent = chunk_bpe.ChunkStore(BYTE), Tokenizer.from_file(BYTE), []
    bare = store.pieces.bare

    class Counted:
        def encode_batch_fast(self, some, add_special_tokens):
            sent.extend(some)
            return bare.encode_batch_fast(some, add_special_tokens=add_special_tokens)

    store.pieces.clear()
    store.pieces.bare = store.tokenizer = Counted()
    try:
        bounds, data = common.offsets_of(pa.array(texts))
        ids, at = store.encode(data, bounds)
    finally:
        store.pieces.bare = bare
    assert all(ids[a:b].tolist() == tok.encode(t).ids for t, a, b in zip(texts, at, at[1:], strict=False))
    assert store.encoded > 50 and sum(map(len, sent)) < 0.3 * len(data)  # the joins and each word once


def test_plain_pieces_get_the_librarys_ids_and_others_too():
    pieces = [" don", "'t", " Wörter", " naïve", " e\u0301t", " \u00a0x", "  ", " ", " <|endoftext|>", "<|endoftext|>", " ABC", " œuvre", " 1234", " ÷×", " à\u0316", " x\x1c", " ~|~", "\n\nend", " ß", " İI", ","]
    for vocabulary in (WORD, BYTE):
        coder, tok = bpe.PieceEncoder(vocabulary), Tokenizer.from_file(vocabulary)
        flat, sizes = coder.encode_new([x.encode() for x in pieces])
        ends = np.cumsum(sizes)
        assert [flat[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)] == [tok.encode(x, add_special_tokens=False).ids for x in pieces]
        data = np.frombuffer("".join(pieces[:5]).encode(), np.uint8)
        assert coder.plain(data, np.concatenate(([0], np.cumsum([len(x.encode()) for x in pieces[:5]])))).tolist() == [True, False, vocabulary == BYTE, True, False]


def test_chunks_refuse_other_pre_tokenizers():
    with pytest.raises(ValueError, match="byte-level"):
        chunk_bpe.ChunkStore(WORD)


def test_lines_of_rows_without_ids_and_of_repeated_rows(spark):
    block = "\n".join(f"line {i}" for i in range(40))
    table = [(None, block), (None, f"{block}\nmore"), (5, block), (5, block), (5, f"{block}\nother"), (6, None)]
    out = line_dedup.judged(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    gone = Counter((r["doc_id"], r["n_lines"]) for r in out if r["n_removed_lines"])
    kept = [r for r in out if r["n_lines"] > 1 and not r["n_removed_lines"]]
    assert len(kept) == 1 and kept[0]["doc_id"] is None and sum(gone.values()) == 4  # the first of the null ids stays whole
    assert len({r["kept"] for r in out if r["doc_id"] == 5 and r["n_lines"] == 40}) == 1


def test_texts_longer_than_a_slice(spark):
    r = random.Random(8)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"w{r.randrange(10**7)}" for _ in range(600_000))  # over SLICE_BYTES
    assert len(long) > common.SLICE_BYTES
    table = [(1, f"{long} {passage}"), (2, f"a {passage} b"), (3, long), (4, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(2)
    got = {x["doc_id"]: x for x in substring_dedup.op8(docs).collect()}
    assert {k: v["n_removed"] for k, v in got.items()} == {1: 600_060, 2: 60, 3: 600_000, 4: 0}
    near = {x["doc_id"]: x["component_id"] for x in near_dedup.op10(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4}
    tok = Tokenizer.from_file(BYTE)
    by = {x["doc_id"]: x["n_tokens"] for x in chunk_bpe.digests(docs, BYTE).collect()}
    assert by[3] == len(tok.encode(long, add_special_tokens=False).ids)


def test_exact_dedup(spark, docs):
    for block in (4096, 7):
        got = block_naming.dedup(docs, block).collect()
        groups = defaultdict(list)
        for d, t, *_ in rows():
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t or ""))
        want = Counter()
        for bare, own in groups.items():
            best = min(own, key=lambda x: (-len(x[1]), x[0] is not None, x[0] or 0))
            for d, t in own:
                want[(d, best[0], len(own), sha(bare))] += 1
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)


def test_packing(spark, docs):
    got = cutting_stock.pack(docs, WORD).collect()
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for d, t, *_ in rows():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for n in cutting_stock.cut_lengths(len(ids)):
            want[(d, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))] += 1
            start += n
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
        total += at
    assert sorted(by) == [*range(len(by))] and len(by) <= -(-total // 4096) + 1


def test_cutting_stock_plan():
    r = np.random.default_rng(2)
    for n in (1, 10, 3000):
        sizes = Counter()
        for x in np.exp(r.normal(6, 1.5, n)).astype(int).tolist():
            sizes.update(cutting_stock.cut_lengths(x + 1))
        plan = cutting_stock.plan(dict(sizes))
        out = Counter()
        for pattern, times in plan:
            assert sum(k * v for k, v in pattern.items()) <= 4096
            for k, v in pattern.items():
                out[k] += v * times
        assert out == sizes
        assert sum(t for _, t in plan) <= -(-sum(k * v for k, v in sizes.items()) // 4096) + 2


def test_topk(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(0, 1, (700, 16)).astype(np.float32)
    vectors[100:110] = vectors[0]
    table = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table += [(700, None), (720, [None] * 16), (740, [float("nan")] * 16), (760, [float("inf")] + [0.0] * 15), (None, vectors[0].tolist()), (20, vectors[1].tolist()), (780, [1.0, 2.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for x in topk_search.search(df).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    whole = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in table if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    for place, (i, q) in enumerate(whole):
        if i % 20 or i == 20:
            continue
        scores = sorted((-int(q @ x), j) for k, (j, x) in enumerate(whole) if k != place and len(x) == len(q))[:20]
        assert sorted(got.pop(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert set(got) == {20} and len(got[20]) == 40


def test_pivots_eliminate():
    r = np.random.default_rng(4)
    centers = r.normal(0, 30, (20, 8))
    x = np.floor((centers[r.integers(0, 20, 6000)] + r.normal(0, 1, (6000, 8))) * 64).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    lifted = topk_search.lift(x, most)
    pivots = topk_search.far_apart(lifted, 24)
    q = x[:30]
    flat = np.column_stack((q.astype(float), np.zeros(30)))
    ids = np.arange(6000)
    found = topk_search.best(q, ids[:30], topk_search.distances(flat, pivots), ids, ids, x, topk_search.distances(lifted, pivots), most, 20)
    assert sum(f[3] for f in found) < 0.5 * 30 * 6000
    for i, at, got, _ in found:
        scores = x @ q[i]
        want = [j for j in np.lexsort((ids, -scores)) if j != i][:20]
        assert ids[at].tolist() == want and got.tolist() == scores[want].tolist()


def test_toxicity(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdeé") for _ in range(5)) for _ in range(300)]
    table, labels = [], []
    for i in range(1500):
        own = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = i % 6 == 0
        for k in range(0, len(own), 10):
            own[k] += "."
        if toxic:
            own[r.randrange(len(own))] = r.choice(["vilething", "vileness", "scumbag"])
        table.append((i, " ".join(own), "en"))
        if i % 3 != 2:
            labels.append((i, int(toxic)))
    table += [(1500, None, None), (None, "a vilething", None), (1501, "", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, score string")
    out = toxicity.op7(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")).collect()
    assert len(out) == len(table)
    held = [x for x in out if x["held_out"] and x["doc_id"] < 1500]
    assert all((zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in held)
    right = sum(x["predicted"] == (x["doc_id"] % 6 == 0) for x in held) / len(held)
    assert right > 0.97
    assert all(0 <= x["score"] <= 1 for x in out)
    clean = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert clean.columns == docs.columns and 1150 < clean.count() < 1350


def repeated(table: list) -> dict:
    seen, place = Counter(), []
    for k, (d, t, *_) in enumerate(table):
        own = WORDS.findall(t or "")
        place.append(own)
        for i in range(len(own) - 34):
            seen[tuple(own[i : i + 35])] += 1
    out = Counter()
    for (d, *_), own in zip(table, place, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - 34):
            if seen[tuple(own[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out[(d, len(own), sum(gone), sha(" ".join(w for w, g in zip(own, gone, strict=True) if not g)))] += 1
    return out


@pytest.mark.parametrize("group", [20_000, 3])
def test_substring_dedup(spark, docs, group):
    got = substring_dedup.judged(docs, group=group, key="doc_id").collect()
    assert Counter((r["key"], r["n_words"], r["n_removed"], sha(r["kept"])) for r in got) == repeated(rows())
    assert substring_dedup.dedup_substrings(docs).columns == docs.columns


def shingles(text: str) -> set:
    own = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not own else {tuple(own)} if len(own) < 5 else {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


@pytest.mark.parametrize("part", [256, 3])
def test_near_dedup(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "FEW_LINKS", 1_000_000 if part > 3 else 0)  # the second time, components by stars
    r = random.Random(9)
    table = rows()[:-4]
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    n = 3 * len(table)
    for k in range(40):  # a chain, each near the next
        base[r.randrange(120)] = f"w{r.randrange(10**6)}"
        table.append((n + k, " ".join(base), *table[0][2:]))
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    sets = {d: shingles(t) for d, t, *_ in table}
    root = {d: d for d in sets}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op10(docs).collect()}
    assert got == {d: (len(sets[d]), top(d), top(d) == d) for d in ids}
    one = near_dedup.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len({top(d) for d in ids})


def test_near_dedup_of_repeated_rows(spark, docs):
    out = near_dedup.op10(docs).collect()
    assert len(out) == len(rows())


def test_gru(spark):
    r = random.Random(8)
    order = [f"w{i}" for i in range(40)]
    table = []
    for i in range(400):
        at, own = r.randrange(40), []
        for _ in range(60):
            own.append(order[at])
            at = (at + r.choice((1, 1, 1, 7))) % 40
        table.append((i, " ".join(own)))
    table += [(400, None), (401, "neverseen Words w1 neverseen"), (None, "w1 w2")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = gru_lm.op9(docs).collect()
    crc = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: [*WORDS.findall((t or "").lower()), "\0"]
    count = Counter(x for d, t in table if not crc(d) for x in tokens(t))
    total = sum(count.values())
    by = {r["doc_id"]: r for r in got}
    for d, t in table:
        own = tokens(t)
        base = sum(np.log10((count[x] + 0.5) / (total + 0.5 * (len(count) + 1))) for x in own)
        x = by[d]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (crc(d), len(own), sum(count[y] > 0 for y in own), total)
        assert abs(x["base_score"] - base) < 1e-6 * max(1, abs(base)) and x["score"] < 0
    held = [by[d] for d, t in table[:400] if crc(d)]
    assert sum(x["score"] for x in held) > 0.75 * sum(x["base_score"] for x in held)  # both below 0


def test_gru_scores_against_word_by_word_sums(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "FREQUENT", 10)
    r = random.Random(12)
    words = [f"v{i}" for i in range(9000)]
    table = [(i, " ".join(words[min(int(r.paretovariate(0.2)), 9000) - 1 if r.random() < 0.5 else r.randrange(9000)] for _ in range(r.randint(0, 90)))) for i in range(900)] + [(900, None), (None, "V1 new")]
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    counts, lexicon, net = gru_lm.fit(docs)
    count = {x["word"]: x["c"] for x in counts.collect()}
    assert len(count) > len(lexicon.words) + 1000 > 2000  # so that some words meet their counts in the join
    place = {w.decode(): int(lexicon.token[i]) for i, w in enumerate(lexicon.words)}
    got = sorted(((x["doc_id"] is None, x["doc_id"]), x["score"]) for x in gru_lm.score(docs).collect())
    want = []
    for d, text in table:
        own = WORDS.findall((text or "").lower())
        state, previous, total = np.zeros((1, net.hidden), np.float32), gru_lm.END, 0.0
        for w, t in [*((w, place.get(w, gru_lm.OTHER)) for w in own), (None, gru_lm.END)]:
            state = net.step(net.x[[previous]] + net.b, state)[0]
            total += np.log10((1 - gru_lm.UNIGRAM) * np.exp(float(net.outputs(state, np.array([t]))[0])) + gru_lm.UNIGRAM * lexicon.share[t])
            if t == gru_lm.OTHER:
                total += np.log10((count.get(w, 0) + 0.5) / (lexicon.outside + 0.5 * (lexicon.outside_words + 1)))
            previous = t
        want.append(((d is None, d), total))
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and abs(x - y) < 1e-3 * max(1, abs(y))


def test_gru_trains_on_rows_of_every_id_and_size(spark):
    docs = spark.createDataFrame([(None, "a b c " * 20)] * 3 + [(0, "w " * (3 << 20))], "doc_id long, text string")  # 0 isn't held out
    _, lexicon, net = gru_lm.fit(docs)
    assert lexicon.total == 3 * 61 + (3 << 20) + 1 and net is not None
    base = gru_lm.Network(3, edges=lexicon.edges).x
    assert all((net.x[lexicon.token[lexicon.words.index(w)]] != base[lexicon.token[lexicon.words.index(w)]]).any() for w in (b"w", b"a", b"b", b"c"))


def test_gru_vocabulary_and_training_grow_with_the_corpus():
    words = [str(i).encode() for i in range(30_000)]
    lexicon = gru_lm.Lexicon(words, np.full(30_000, 3000), 90_000_000, 30_000, 10)
    assert np.count_nonzero(lexicon.token) == lexicon.side**2 - 2 > 20_000
    r = np.random.default_rng(0)
    docs = [np.append(r.integers(2, 900, n), gru_lm.END).astype(np.int32) for n in r.integers(0, 60, 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in docs], pa.binary())], ["tokens"])
    net = gru_lm.Network(3)
    out = list(gru_lm.train_task(iter([batch, batch]), gru_lm.packed(net, gru_lm.squares_of(net)), net.edges))
    assert {x["n"] for y in out for x in y.to_pylist()} == {2 * sum(map(len, docs))}


def test_near_dedup_keeps_every_blank_row(spark):
    table = [(None, " ", "a"), (None, " ", "b"), (7, None, "c"), (7, "", "d"), (8, "one two three four five six", "e"), (8, "one two three four five six", "f")]
    out = near_dedup.keep_one(spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)).collect()
    sources = sorted(r["source"] for r in out)
    assert sources[:4] == ["a", "b", "c", "d"] and len(sources) == 5


def test_gru_distribution_sums_to_one():
    net = gru_lm.Network(1, classes=4, in_class=4, hidden=5)
    states = np.random.default_rng(0).normal(0, 1, (3, 5)).astype(np.float32)
    total = sum(np.exp(net.outputs(states, np.full(3, t))) for t in range(16))
    assert np.allclose(total, 1, atol=1e-5)


def test_gru_slopes_are_those_of_finite_differences():
    net = gru_lm.Network(4, edges=np.array([0, 1, 3, 8]), hidden=3)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    r = np.random.default_rng(2)
    inputs, targets, real = r.integers(0, 8, (6, 2)), r.integers(0, 8, (6, 2)), np.ones((6, 2), bool)
    real[4:, 1] = False

    def loss() -> float:
        state, total = np.zeros((2, 3)), 0.0
        for t in range(6):
            state = net.step(net.x[inputs[t]] + net.b, state)[0]
            total -= net.outputs(state, targets[t])[real[t]].sum()
        return total

    want = {}
    for n in net.NAMES:
        held = getattr(net, n)
        slope = np.zeros_like(held)
        for i in np.ndindex(held.shape):
            own = held[i]
            held[i] = own + 1e-5
            up = loss()
            held[i] = own - 1e-5
            slope[i] = (up - loss()) / 2e-5
            held[i] = own
        want[n] = slope
    before = {n: getattr(net, n).copy() for n in net.NAMES}
    squares = {n: np.full_like(before[n], 1e12) for n in net.NAMES}  # so large that a step is the slope, scaled
    net.learn(inputs, targets, real, np.zeros((2, 3)), squares, 1e6)
    for n in net.NAMES:
        got = 2 * (before[n] - getattr(net, n))  # learn divides by the lanes
        assert np.allclose(got, np.clip(want[n], -2, 2), atol=1e-4), n


def test_scores_carry_state_across_windows():
    net = gru_lm.Network(2, classes=4, in_class=4, hidden=5)
    r = np.random.default_rng(1)
    docs = [r.integers(1, 16, n).astype(np.int32) for n in (1, 31, 32, 33, 100, 5)]
    share = np.full(16, 1 / 16)
    got = gru_lm.document_scores(net, share, docs, lanes=3)
    for doc, score in zip(docs, got, strict=True):
        state, previous, want = np.zeros((1, 5), np.float32), gru_lm.END, 0.0
        for t in doc:
            state = net.step(net.x[[previous]] + net.b, state)[0]
            want += np.log10(0.95 * np.exp(net.outputs(state, np.array([t]))[0]) + 0.05 / 16)
            previous = t
        assert abs(score - want) < 1e-3


def test_pieces_give_the_librarys_ids_around_marks_case_and_special_tokens():
    from corpusloom.llm.common import offsets_of

    draw = random.Random(4)
    letters = "abABJTY1_-$|<>.,;:!?'s̸̈̊̇\x1c ́éÅ٣ \n\t"
    held = ["<|ENDOFTEXT|> <|endOfText|>,a<|startoftext|>B", "x<|endoftext|>.y", "J̌ H̱ Y̊ İ Á aJ", "a_B-c$$$ D|E|f&&&", "X≠", "DON'T I'LL x'S", "1,234.56:7", ""]
    held += ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(1500)]
    bounds, data = offsets_of(pa.array(held))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        coder = bpe.PieceEncoder(public_tokenizers.path(name))
        ids, at = coder.encode(data, bounds)
        want = coder.tokenizer.encode_batch(held, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [x.ids for x in want]


def test_gru_tree_of_outputs():
    r = np.random.default_rng(6)
    share = 1 / np.arange(1, 5001)
    words, branches = gru_lm.tree_of(share / share.sum())
    sizes = np.diff(words)
    assert sizes.max() <= gru_lm.TOGETHER and words[-1] == 5000 and branches[-1] == len(sizes)
    # outputs that a token of this corpus meets; two levels of equal roots of the shares meet over 100
    p = np.add.reduceat(share, words[:-1]) / share.sum()
    of = np.repeat(np.arange(len(branches) - 1), np.diff(branches))
    assert len(branches) - 1 + (p * (np.diff(branches)[of] + sizes * (sizes > 1))).sum() < 70
    edges = np.array([0, 1, 2, 6, 9, 13, 14]), np.array([0, 1, 4, 6])
    net = gru_lm.Network(4, edges=edges, hidden=3)
    net.start(np.arange(1, 15) / 105)
    states = r.normal(0, 1, (40, 3)).astype(np.float32)
    total = sum(np.exp(net.outputs(states, np.full(40, t))) for t in range(14))
    assert np.allclose(total, 1, atol=1e-5)
    assert np.allclose([np.exp(net.outputs(np.zeros((1, 3), np.float32), np.array([t]))[0]) for t in range(14)], np.arange(1, 15) / 105, atol=1e-5)
    targets = r.integers(0, 14, 40)
    before = net.outputs(states, targets)
    net.m[:, -1] += 300  # beyond what the exponential function takes
    net.w[2:6, -1] -= 300
    assert np.allclose(net.outputs(states, targets), before, atol=1e-3)
    # slopes by state and by weight
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    states, got = states.astype(np.float64), {n: np.zeros_like(getattr(net, n)) for n in "cmw"}
    _, slopes = net.outputs(states, targets, lambda name, rows, slope: got[name].__setitem__(rows, slope))
    loss = lambda: -net.outputs(states, targets).sum()
    for held, want in ((states, slopes), *((getattr(net, n), got[n]) for n in "cmw")):
        for i in np.ndindex(held.shape):
            own = held[i]
            held[i] = own + 1e-5
            up = loss()
            held[i] = own - 1e-5
            assert abs((up - loss()) / 2e-5 - want[i]) < 1e-4
            held[i] = own
