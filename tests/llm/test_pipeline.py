import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_operators import WORD, WORDS, line_chunks, repeated, sha, shingles
from tokenizers import Tokenizer

from corpusloom.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string, key string"


def corpus() -> tuple[list, list]:
    r = random.Random(21)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(600)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, block = line(70), "\n".join(line(8) for _ in range(14))
    texts = [None, "", " \n", "one", line(4)]
    for i in range(400):
        own = [line(r.randint(4, 12)) + "." for _ in range(r.randint(2, 9))]
        if i % 5 == 0:
            own.insert(r.randrange(len(own)), f"{r.choice(words)} vilest{r.choice('abc')} slur {r.choice(words)}.")
        texts.append("\n".join(own))
    toxic = {i for i, t in enumerate(texts) if t and "slur" in t}
    clean = [t for i, t in enumerate(texts) if i > 5 and i not in toxic]
    texts += [f"{line(20)} {passage} {line(20)}", f"{line(30)} {passage}", f"{line(30)}\n{block}", f"{line(25)}\n{block}\n{line(9)}"]
    texts += [clean[0], clean[1] + " ", clean[2].upper(), clean[3] + " end", clean[0]]
    rows = [(3 * i, t, "en", "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [(None, clean[5], "en", "s", 1, None, None, None), (None, None, None, None, None, None, None, None), rows[7], rows[7]]
    return rows, [(3 * i, int(i in toxic)) for i in range(405)]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The corpus's folder, and what went into and came out of each stage."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, held = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{name}")
        after = spark.read.parquet(f"{path}/{name}")
        held[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return path, held


def test_columns_stay(staged):
    for _, (before, _, columns) in [*staged[1].items()][:-1]:
        assert sorted(columns) == sorted(SCHEMA.split()[::2]) and len(before) > 100


def test_toxic_documents_go_and_others_stay(staged):
    before, after, _ = staged[1]["toxicity"]
    bad = lambda rows: sum("slur" in (x["text"] or "") for x in rows)
    assert bad(before) >= 80 and bad(after) == 0
    assert len(after) == len(before) - bad(before)
    assert Counter(x["text"] for x in after) == Counter(x["text"] for x in before if "slur" not in (x["text"] or ""))


def test_lines_against_brute_force(staged):
    before, after, _ = staged[1]["line_dedup"]
    want, seen = [], {}
    texts = {(x["doc_id"] is not None, x["doc_id"] or 0, x["text"] or "") for x in before}
    order = sorted(texts, key=lambda x: x[:2])
    by = {}
    for known, doc_id, text in order:
        kept = []
        for c in line_chunks(text):
            if len(c) > 1 and seen.setdefault(tuple(c), (known, doc_id)) != (known, doc_id):
                continue
            kept += c
        by[known, doc_id, text] = "\n".join(kept)
    want = Counter((x["doc_id"], by[x["doc_id"] is not None, x["doc_id"] or 0, x["text"] or ""]) for x in before)
    assert Counter((x["doc_id"], x["text"]) for x in after) == want
    assert all(x["n_chars"] is None or x["n_chars"] == len(x["text"]) for x in after)
    assert sum(len(x["text"]) for x in after) < sum(len(x["text"] or "") for x in before)


def test_near_copies_against_brute_force(staged):
    before, after, _ = staged[1]["near_dedup"]
    sets = [shingles(x["text"]) for x in before]
    root = [*range(len(before))]

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, x in enumerate(before):
        groups[top(i)].append(x)
    assert len(after) == len(groups) < len(before)
    least = Counter(min((x["doc_id"] is None, x["doc_id"] or 0) for x in g) for g in groups.values())
    assert Counter((x["doc_id"] is None, x["doc_id"] or 0) for x in after) == least


def test_passages_against_brute_force(staged):
    before, after, _ = staged[1]["substring_dedup"]
    want = repeated([(x["doc_id"], x["text"]) for x in before])
    got = Counter()
    for x in after:
        got[(x["doc_id"], sha(" ".join(WORDS.findall(x["text"]))))] += 1
    assert got == sum((Counter({(k[0], k[3]): n}) for k, n in want.items()), Counter())
    assert sum(k[2] for k in want) >= 140  # the planted passage, twice
    unchanged = {x["doc_id"]: x["text"] or "" for x in before}
    gone = {k[0] for k in want if k[2]}
    assert all(x["text"] == unchanged[x["doc_id"]] for x in after if x["doc_id"] not in gone and x["doc_id"] is not None)


def test_packing_holds_every_id_once(staged):
    before, after, _ = staged[1]["packing"]
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for x in before:
        want[x["doc_id"]] += len(tok.encode(x["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for x in after:
        got[x["doc_id"]] += x["length"]
    assert got == want
    by = defaultdict(list)
    for x in after:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096


def test_run_gives_the_last_stages_rows(spark, staged):
    path, held = staged
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(x["doc_id"] for x in held["packing"][1])
    assert sum(x["length"] for x in got) == sum(x["length"] for x in held["packing"][1])


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_noisy_or_against_brute_force():
    text = ["bad day. good day! bad", "fine words here", "", "awful. bad awful words. here"]
    label = np.array([1.0, 0.0, 0.0, 1.0])
    bag = toxicity.Bags(pa.array(text), 10)
    r = np.random.default_rng(1)
    weight, bias = np.abs(r.normal(0, 0.3, 1 << 10)), -1.5
    sentences = [[["bad", "day."], ["good", "day!"], ["bad"]], [["fine", "words", "here"]], [], [["awful."], ["bad", "awful", "words."], ["here"]]]

    def loss(weight: np.ndarray, bias: float) -> float:
        total = 0.0
        for own, y in zip(sentences, label, strict=True):
            stay = 1.0
            for s in own:
                z = bias
                for w in s:
                    features, _ = toxicity.word_features(pa.array([w.encode()], pa.large_binary()), 10)
                    z += weight[features].sum()
                stay *= 1 - 1 / (1 + np.exp(-z))
            total -= np.log(1 - stay) if y else np.log(stay)
        return total

    slopes = toxicity.sentence_slopes(bag, label, weight, bias)
    on_bias = (loss(weight, bias + 1e-5) - loss(weight, bias - 1e-5)) / 2e-5
    assert abs(slopes.sum() - on_bias) < 1e-6
    back = bag.back(slopes, 1 << 10)
    for i in np.flatnonzero(back)[:12]:
        step = np.zeros_like(weight)
        step[i] = 1e-5
        assert abs(back[i] - (loss(weight + step, bias) - loss(weight - step, bias)) / 2e-5) < 1e-6


def test_repeated_rows_score_alike(spark):
    r = random.Random(2)
    table = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(20)) + (" slurword" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*table, table[4], table[4], (None, table[4][1])], "doc_id long, text string")
    out = toxicity.op7(docs, labels).collect()
    same = [x["score"] for x in out if x["doc_id"] == 4 or x["doc_id"] is None]
    assert len(out) == 203 and len(same) == 4 and len(set(same)) == 1


def test_bags_hold_little_besides_their_words_numbers():
    """What training keeps of its texts: numbers of words, not their bytes and places."""
    text = pa.array([f"some words of text {i % 50}. and more of them " * 40 for i in range(200)])
    held = [x for x in vars(toxicity.Bags(text)).values() if not isinstance(x, int)]
    assert all(isinstance(x, np.ndarray) for x in held) and sum(x.nbytes for x in held) < 2 * text.nbytes
