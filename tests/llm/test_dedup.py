"""Exact and near de-duplication and sentence spans against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from oracle import same
from tidegauge.llm import components, exact_dedup, hyper_minhash, sentence_spans, shared

DOCS = "doc_id long, text string, keep_id string, row string"


def docs(spark, rows):
    """With further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def test_exact_dedup_is_the_oracle_s(spark, sf):
    same(exact_dedup.query(spark, sf), exact_dedup.ORACLE, sf)


def test_exact_dedup_edges(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (5, None), (4, ""), (None, "a b"), (7, "z" * 200_000), (7, "z" * 200_000), (8, "a b "), (9, "à b")]
    got = exact_dedup.exact_dedup(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "keep_id", "row", "keep_id_", "group_size", "kept", "text_sha256"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.keep_id_, r.group_size, r.kept))
    assert by[1] == [(1, 4, True)] and by[2] == [(1, 4, False)] and by[3] == [(1, 4, False)] and by[None] == [(1, 4, False)]
    assert by[5] == [(4, 2, False)] and by[4] == [(4, 2, True)] and by[8] == [(8, 1, True)] and by[9] == [(9, 1, True)]
    assert sorted(by[7]) == [(7, 2, False), (7, 2, True)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_writes_only_what_is_carried(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(exact_dedup, "written", lambda df, label: seen.append((label, df.columns)) or shared.written(df, label))
    exact_dedup.query(spark, sf)
    assert dict(seen)["hashed"] == ["doc_id", "text_sha256", "row_no"]
    rows = docs(spark, [(1, "a"), (2, "a"), (3, "b")])
    assert exact_dedup.exact_dedup(rows, carried=["row"]).columns == ["row", "keep_id_", "group_size", "kept", "text_sha256"]


def test_exact_dedup_with_a_full_filter_loses_nothing(spark):
    rows = [(i, f"t{i % 700}") for i in range(1000)]
    got = exact_dedup.exact_dedup(docs(spark, rows), max_filter_bytes=1, probes=1)
    assert got.filter("kept").count() == 700 and got.filter("group_size = 2").count() == 600


def test_exact_dedup_is_native(spark, sf):
    assert not re.search("Python|Pandas|Arrow", exact_dedup.query(spark, sf)._jdf.queryExecution().executedPlan().toString())


def brute(rows, width, up, down):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if c * down >= up * (len(sets[a]) + len(sets[b]) - c) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    low = {}
    for i in ids:
        low[find(i)] = min(low.get(find(i), i), i)
    return {i: (len(sets[i]), low[find(i)]) for i in ids}


def varied(seed, groups, copies, words):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [4, 1000])
def test_near_dedup_is_brute_force_s(spark, monkeypatch, tile):
    monkeypatch.setattr(hyper_minhash, "TILE", tile)
    rows = [*varied(1, 6, 14, 80), *[(1000 + i, t) for i, t in enumerate(["", None, "one", "ONE", "one two", "One  Two", "é É", "É é", "a b c", "a b c"])]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyper_minhash.near_dedup(docs(spark, rows), width=3, share=(85, 100)).collect()}
    assert got == brute(rows, 3, 85, 100)


@pytest.mark.parametrize("bucket", [3, 1000])
def test_near_dedup_of_pages_that_share_much_is_brute_force_s(spark, monkeypatch, bucket):
    """Half of every text is the same, so bands of most pairs meet; only copies may hang together."""
    monkeypatch.setattr(hyper_minhash, "BUCKET", bucket)
    rng = random.Random(12)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, f"{shared} " + " ".join(f"o{i}x{k}" for k in range(60 - rng.randrange(20)))) for i in range(120)]
    rows += [(200 + i, t + " end" * (i % 2)) for i, t in rows[:30]]
    groups = []
    monkeypatch.setattr(hyper_minhash, "components", lambda edges: groups.append(components.components(edges)) or groups[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyper_minhash.near_dedup(docs(spark, rows), width=3, share=(85, 100)).collect()}
    assert got == brute(rows, 3, 85, 100)
    largest = max(r["count"] for r in groups[0].groupBy("root").count().collect())
    assert largest < 10 if bucket == 1000 else largest > 50


def test_near_dedup_edges(spark):
    assert hyper_minhash.near_dedup(docs(spark, [])).count() == 0
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (None, "A B C D E F"), (None, None)]
    got = hyper_minhash.near_dedup(docs(spark, rows)).collect()
    assert sum(r.kept for r in got) == 2 and {r.component_id for r in got if r.n_shingles} == {2}


def test_estimates_and_registers():
    import numpy as np

    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    share = (hyper_minhash.registers(a[:3500]) == hyper_minhash.registers(a[500:])).mean()
    assert abs(share - 3000 / 4000) < 0.2
    apart = (hyper_minhash.registers(a[:2000]) == hyper_minhash.registers(a[2000:])).mean()
    assert apart < 0.05 and 0 < hyper_minhash.chance(np.float64(10), np.float64(10)) < 2e-4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PASSAGE = "The quick brown fox jumps over a lazy dog near the river. It then turns around and looks back at the old mill for a while. Nobody sees it leave again before the night has come. In the end all was quiet there."


def test_sentence_spans_remove_later_copies(spark):
    rows = [(5, f"Own words here. {PASSAGE} The end."), (2, f"{PASSAGE}"), (9, f"Something else was said first! {PASSAGE}\nAnd {PASSAGE}"), (4, "Nothing is repeated in this text. Not at all."), (6, None), (7, "")]
    got = {r.doc_id: r for r in sentence_spans.dedup_sentences(docs(spark, rows)).collect()}
    assert got[2].clean == PASSAGE and got[2].n_removed == 0 and got[4].n_removed == 0 and got[6].clean == "" and got[7].clean == ""
    assert got[5].clean == "Own words here. The end." and got[9].clean.startswith("Something else was said first! And The quick")
    for i, t in rows:
        spans = [tuple(map(int, s.split(":"))) for s in got[i].removed.split(",") if s]
        assert sum(b - a for a, b in spans) == got[i].n_chars_removed and len(t or "") - got[i].n_chars_removed == len(got[i].clean)
    assert sentence_spans.dedup_sentences(docs(spark, [])).count() == 0


def windows(texts, size):
    """(id, first word, window) in the order of ids, and the stretch of every word of each text."""
    at = {i: [m.span() for m in re.finditer("[^ \t-\r]+", t)] for i, t in texts.items()}
    for i in sorted(texts):
        words = [texts[i][a:b] for a, b in at[i]]
        for k in range(len(words) - size + 1):
            yield i, at[i][k : k + size], tuple(words[k : k + size])


def test_sentence_spans_are_brute_force_s(spark, sf):
    """Each window of 51 words that stood before loses words, and each word lost is in a window of 7 that stood before."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    gone, clean = {}, {}
    for r in sentence_spans.query(spark, sf).collect():
        gone[r.doc_id] = [tuple(map(int, x.split(":"))) for x in r.removed.split(",") if x]
        clean[r.doc_id] = (r.clean, r.n_chars_removed, r.n_removed > 0)
    lost = {i: {c for a, b in spans for c in range(a, b)} for i, spans in gone.items()}
    assert clean == {i: ("".join(c for n, c in enumerate(t) if n not in lost[i]), len(lost[i]), bool(lost[i])) for i, t in texts.items()}
    seen, found = set(), 0
    for i, where, window in windows(texts, 51):
        if window in seen:
            found += 1
            assert any(a in lost[i] for a, _ in where)
        seen.add(window)
    assert found > 100
    seen, justified = set(), collections.defaultdict(set)
    for i, where, window in windows(texts, 7):
        if window in seen:
            justified[i].update(a for a, _ in where)
        seen.add(window)
    starts = {i: {m.start() for m in re.finditer("[^ \t-\r]+", t)} for i, t in texts.items()}
    assert all(lost[i] & starts[i] <= justified[i] for i in texts)


def test_sentence_spans_edges(spark):
    wide = "".join(f"第{k}句话在这里。" for k in range(30))
    long = " ".join(f"u{k}" for k in range(200_000))
    rows = [(1, wide), (2, f"別の始まり。{wide}"), (3, long), (4, long), (5, "x" * 2_000_000 + f". {PASSAGE}"), (6, PASSAGE), (None, PASSAGE), (7, '\ud7ff "So!" (he said.) ' + PASSAGE)]
    got = collections.defaultdict(list)
    for r in sentence_spans.dedup_sentences(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert got[1][0].clean == wide and got[2][0].clean == "別の始まり。" and got[3][0].clean == long and got[4][0].clean == ""
    assert got[6][0].clean == "" and got[None][0].clean == "" and got[5][0].n_removed == 0
    assert got[7][0].clean == '\ud7ff "So!" (he said.) '
    assert got[2][0].removed == f"6:{len(wide) + 6}"


def words_of(rng, n):
    return [f"w{rng.randrange(10**9)}" + rng.choice(["", "", "", "", "", ".", "!"]) for _ in range(n)]


def test_sentence_spans_find_every_passage_of_51_words(spark):
    """Against a brute force over windows of 51 words: passages within sentences, between hosts of any length."""
    rng = random.Random(11)
    rows = [(-2, " ".join(f"a{i}" for i in range(2)) + " " + " ".join(f"p{i}" + "." * (i in (16, 33)) for i in range(51)) + " host end."), (-1, " ".join(f"b{i}" for i in range(10)) + " " + " ".join(f"p{i}" + "." * (i in (16, 33)) for i in range(51)) + " other end.")]
    for i in range(120):
        passage = words_of(rng, 51)
        passage[-1] = passage[-1].strip(".!")
        rows += [(2 * i + j, " ".join(["Own", *words_of(rng, rng.randrange(40)), "host", *passage, "goes", *words_of(rng, rng.randrange(40)), "on."])) for j in (0, 1)]
    rows += [(1000 + i, " ".join(words_of(rng, 200))) for i in range(20)]
    seen, expected = set(), set()
    for i, t in sorted(rows):
        w = t.split()
        own = {tuple(w[k : k + 51]) for k in range(len(w) - 50)}
        if own & seen:
            expected.add(i)
        seen |= own
    assert len(expected) == 121
    got = {r.doc_id for r in sentence_spans.dedup_sentences(docs(spark, rows)).filter("n_removed > 0").collect()}
    assert got == expected


@pytest.fixture
def split_anew(spark, tmp_path):
    """A table of documents with copies in eight files, read as one split, and what makes later scans of it eight."""
    names = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {x: spark.conf.get(x, None) for x in names}
    words = [" ".join(f"v{g}x{k}" for k in range(60)) + "." for g in range(40)]
    rows = [(i, words[i * 7 % 40]) for i in range(160)]
    for n in range(8):
        spark.createDataFrame(rows[n::8], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    for x, value in names.items():
        spark.conf.set(x, value)
    table = spark.read.parquet(str(tmp_path / "docs"))
    assert table.rdd.getNumPartitions() == 1
    yield table, lambda: spark.conf.set("spark.sql.files.minPartitionNum", "8")
    for x, value in before.items():
        if value is None:
            spark.conf.unset(x)
        else:
            spark.conf.set(x, value)


def first_ids():
    low = {}
    for i in range(160):
        low.setdefault(i * 7 % 40, i)
    return sorted(low.values())


def test_exact_dedup_keeps_one_when_later_scans_are_split_otherwise(split_anew):
    table, change = split_anew
    got = exact_dedup.exact_dedup(table)
    change()
    assert sorted(r.doc_id for r in got.filter("kept").collect()) == first_ids()


def test_near_dedup_keeps_one_when_later_scans_are_split_otherwise(spark, split_anew):
    import corpus_pipeline

    table, change = split_anew
    got = corpus_pipeline.without_near_copies(spark, table, "")
    change()
    assert sorted(r.doc_id for r in got.collect()) == first_ids()


def test_sentence_spans_when_later_scans_are_split_otherwise(split_anew):
    table, change = split_anew
    got = sentence_spans.dedup_sentences(table)
    change()
    assert sorted(r.doc_id for r in got.filter("n_removed = 0").collect()) == first_ids()


def test_clashing_names_and_hashes(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(1, "a\n\nb")])).first()
    assert got.text_sha256 == hashlib.sha256(b"a b").hexdigest() and got.keep_id == "x"
    assert docs(spark, []).select(F.max("doc_id")).first()[0] is None
