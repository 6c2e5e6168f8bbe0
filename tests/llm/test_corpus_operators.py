"""Near duplicates, vectors, mixing, importance, fixity and the pipeline: against brute force."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from credence.llm import common, importance, mixing, near_copies, sentencepiece_bpe, simhash, tree_forest, warc_fixity
from credence.llm.registry import ORACLES, QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


def united(keys, pairs):
    """Least key of each key's component."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if p[0] != p[1]]
    expected = united({k for p in real for k in p}, real)
    assert found == expected
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_a_shared_folder_is_asked_for(spark):
    assert common.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_cache_stays_bounded():
    c = common.Cache(lambda k: k * 2, 10)
    assert [c[str(i)] for i in range(100)] == [str(i) * 2 for i in range(100)]
    assert len(c) + len(c.old) <= 20 and c["x" * 100] == "x" * 200 and "x" * 100 not in c


# 5 -------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x1c").split(" ")
    words = [w for part in words for w in _split(part)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(part):
    out = [""]
    for c in part:
        if c in "\t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def check_near(df):
    data = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    found = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    fps = sorted({f for _, f in data})
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    root = united(fps, near)
    least = {}
    for k, f in data:
        if k is not None:
            least[root[f]] = min(k, least.get(root[f], k))
    assert found == Counter((k, f, least.get(root[f])) for k, f in data)


def test_near_duplicates(spark, odd_documents, sample):
    check_near(sample)
    check_near(odd_documents)
    assert simhash.near_duplicates(sample.limit(0)).isEmpty()


def test_links_reach_two_bits(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), base ^ (7 << 20), 0]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in pairs)
    assert united(signed, pairs) == united(signed, near)


# 4 -------------------------------------------------------------------------------


def plain_vectors(data, cosine=0.98):
    unit = []
    for _, v, label in data:
        ok = v and label is not None and None not in v and all(math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links, pairs = [0] * len(data), []
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and data[i][2] == data[j][2] and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                pairs.append((j, i))
    root = united(range(len(data)), pairs)
    least = {}
    for i, (k, _, _) in enumerate(data):
        least[root[i]] = min(k, least.get(root[i], k))
    return Counter((k, links[i], least[root[i]], k == least[root[i]]) for i, (k, _, _) in enumerate(data))


def vectors(seed, noises, groups=4, dim=16):
    rng = np.random.default_rng(seed)
    centres, out = rng.normal(size=(groups, dim)), []
    for c in range(groups):
        for noise, n in noises:
            for _ in range(n):
                out.append((len(out), [float(np.float32(x)) for x in centres[c] + rng.normal(size=dim) * noise * np.linalg.norm(centres[c]) / 4], c % 2))
    return out


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("noises", [[(0.001, 60), (2.0, 40)], [(0.02, 40), (0.06, 40), (0.09, 40)]])
def test_vectors(spark, monkeypatch, noises):
    monkeypatch.setattr(tree_forest, "LEAF", 40)
    data = vectors(1, noises)
    found = Counter(tuple(r) for r in tree_forest.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect())
    assert found == plain_vectors(data)


def test_odd_vectors(spark):
    nan = float("nan")
    data = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 0), (8, [2.0, 2.0], 0), (8, [2.0, 2.0], 0), (9, [1.0, 1.0, 1.0], 0), (10, [1.0, 1.0], 1), (11, [1e300, 1e300], 0), (12, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS rid", "'x' AS vec", "2 AS dim", "3 AS key")
    assert Counter(tuple(r) for r in tree_forest.near_duplicates(df).collect()) == plain_vectors(data[:11] + [(11, [1.0, 1.0], 0)] + data[12:])
    assert tree_forest.near_duplicates(df.limit(0)).isEmpty()


def test_recall_of_split_trees(spark):
    """One label of more vectors than leaves hold, at the real ``LEAF``; links close to the threshold."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(2600, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(axis=1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    cos = rng.uniform(0.981, 0.985, len(base))[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * off, np.repeat(base[:1], 30, axis=0)])
    expected = (x @ x.T >= 0.98).sum(axis=1) - 1
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found = {r["vec_id"]: r["n_links"] for r in tree_forest.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(found[i] <= n for i, n in enumerate(expected.tolist()))
    assert sum(found.values()) >= 0.97 * expected.sum()


def test_vectors_without_ids_and_long_ones(spark):
    long = [float(i % 7) for i in range(5000)]
    data = [(None, long, 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.001], 0), (5, long, 0), (None, [0.0, 1.0], 0)]
    found = Counter(tuple(r) for r in tree_forest.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect())
    assert found == Counter([(None, 1, 5, False), (5, 1, 5, True), (None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)])


# 7 -------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, 166.66666666666666, 83.33333333333333]
    assert mixing.targets([], []) == [] and mixing.targets([0, 10], [5, 2]) == [0.0, 15.0]


def test_quotas_split_exactly():
    quotas = np.array([100, 37, 0, 1])
    by_shard = mixing.split_quotas(quotas, 7)
    assert (by_shard.sum(axis=0) == quotas).all() and (by_shard >= 0).all()
    assert by_shard.sum(axis=1).max() - by_shard.sum(axis=1).min() <= 3
    assert (mixing.split_quotas(quotas, 7) == by_shard).all()


def test_targets_of_many_sources():
    rng = random.Random(12)
    sizes = [rng.choice([0, 1, 5, 1000, rng.randrange(10**6)]) for _ in range(100_000)]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * n for t, n in zip(got, sizes))
    below = [t / w for t, w, n in zip(got, weights, sizes) if t < 2 * n]
    assert max(below) == pytest.approx(min(below)) and all(t / w <= max(below) * (1 + 1e-9) for t, w in zip(got, weights))
    p = mixing.plan([(str(i), n) for i, n in enumerate(sizes)], shard_words=1 << 22)
    assert p["shards"] == -(-sum(p["take"]) // (1 << 22)) > 1000


def test_nodes_beyond_the_generator_are_halved_in_proportion():
    have = np.array([6 * 10**9, 10**9 + 1, 7])
    mid, left = mixing.halved(have, 0, 8, 1)
    assert mid == 4 and left.sum() == have.sum() // 2 and (abs(left - have / 2) <= 1).all()


def test_the_top_of_the_tree_and_the_rest_agree(monkeypatch):
    quotas = np.array([100, 37, 0, 1, 900])
    of = np.flatnonzero(quotas)
    dense, again = mixing.split_quotas(quotas, 64), np.zeros((64, 5), np.int64)
    first = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(dense, axis=0)])
    for low, high, *node in mixing.leaves_of(0, 64, of, quotas[of], np.zeros(4, np.int64), mixing.SEED, 40):
        for shard, _, some, have, start in mixing.leaves_of(low, high, *node, mixing.SEED):
            again[shard, some] = have
            assert (first[shard, some] == start).all()
    assert (again == dense).all()


def plain_mix(df, block, shard_words, seed=mixing.SEED):
    """Words of each (shard, source), and what is taken of each (key, text), from blocks in the order of their digests."""
    from hashlib import md5

    digest = lambda *parts: md5(":".join(map(str, parts)).encode()).hexdigest()
    docs = {}
    for r in df.collect():
        text = r["text"] or ""
        words = len([w for w in _split(text.replace(" ", "\t")) if w])
        place = digest(seed, *([] if r["doc_id"] is None else [r["doc_id"]]), md5(text.encode()).hexdigest())
        docs.setdefault(r["source"], []).append((place, r["doc_id"], text, words))
    p = mixing.plan([(s, sum(d[3] for d in rows)) for s, rows in docs.items()], block_words=block, shard_words=shard_words)
    drawn, quotas = [], []
    for s, size, take in zip(p["sources"], p["sizes"], p["take"]):
        mine, turn = [], 0
        while take > 0:
            name = "" if s is None else f"={s}"
            for b in sorted(range(-(-size // block)), key=lambda b: digest(seed, name, turn, b)):
                keep = min(block, size - b * block, take)
                if keep > 0:
                    mine.append((b, keep))
                    take -= keep
            turn += 1
        drawn.append(mine)
        quotas.append(len(mine))
    ends = np.cumsum(mixing.split_quotas(np.array(quotas), p["shards"], seed), axis=0)
    by_shard, taken = Counter(), Counter()
    for i, (s, mine) in enumerate(zip(p["sources"], drawn)):
        stream = [(d[1], d[2]) for d in sorted(docs[s]) for _ in range(d[3])] if all(d[1] is not None for d in docs[s]) else [(d[1], d[2]) for d in sorted(docs[s], key=lambda d: d[0]) for _ in range(d[3])]
        for place, (b, keep) in enumerate(mine):
            by_shard[(int(np.searchsorted(ends[:, i], place, side="right")), s)] += keep
            taken.update(stream[b * block : b * block + keep])
    return by_shard, taken, p


@pytest.mark.parametrize(("block", "shard_words"), [(64, 2000), (4096, 8000)])
def test_mix(spark, odd_documents, sample, block, shard_words):
    """Words by shard and source, and of each document, equal what the blocks' order and the tree give."""
    options = {"block_words": block, "shard_words": shard_words}
    for df in (sample, odd_documents):
        got = mixing.mix(df, **options).collect()
        by_shard, taken, p = plain_mix(df, block, shard_words)
        assert len(got) == df.count()
        found = Counter()
        for r in got:
            assert r["taken"] <= 2 * r["size"] and sum(d["words"] for d in r["draws"]) == r["taken"]
            found.update({(d["shard"], r["source"]): d["words"] for d in r["draws"]} if len({d["shard"] for d in r["draws"]}) == len(r["draws"]) else {})
            if len({d["shard"] for d in r["draws"]}) != len(r["draws"]):
                for d in r["draws"]:
                    found[(d["shard"], r["source"])] += d["words"]
        assert found == by_shard
        all_of = Counter()
        for r in got:
            all_of[(r["doc_id"], r["size"])] += r["taken"]
        expected = Counter()
        for (key, text), n in taken.items():
            expected[(key, len([w for w in _split(text.replace(" ", "\t")) if w]))] += n
        assert +all_of == +expected
        words = Counter()
        for r in got:
            words[r["source"]] += r["taken"]
        assert words == Counter({s: t for s, t in zip(p["sources"], p["take"]) if t}) and all(abs(t - g) <= 0.5 for t, g in zip(p["take"], p["targets"]))
        again = mixing.mix(df.repartition(3), **options)
        plain = lambda rows: Counter((r["doc_id"], r["taken"], tuple(tuple(d) for d in r["draws"])) for r in rows)
        assert plain(again.collect()) == plain(got)
    assert mixing.mix(sample.limit(0)).isEmpty()


@pytest.mark.parametrize("block", [64, 4096])
def test_mixed_rows(odd_documents, sample, block):
    for df in (sample, odd_documents, odd_documents.withColumn("n", F.monotonically_increasing_id())):
        out = mixing.mixed_rows(df, block_words=block, shard_words=2000)
        assert out.columns == df.columns
        words = lambda d: Counter({(r[0], r[1]): r[2] for r in d.groupBy("doc_id", "source").agg(F.sum(common.word_count(F.col("text")))).collect()})
        expected = Counter()
        for r in mixing.mix(df, block_words=block, shard_words=2000).collect():
            expected[(r["doc_id"], r["source"])] += r["taken"]
        assert +expected == +words(out)
    odd = mixing.mixed_rows(odd_documents.withColumn("n", F.monotonically_increasing_id()), block_words=block)
    assert odd.where("doc_id = 6").select("n").distinct().count() == 2  # rows that differ elsewhere are told apart
    assert mixing.mixed_rows(sample.limit(0)).isEmpty()


def test_texts_are_cut_before_they_move_to_shards(sample):
    plan = mixing.mixed_rows(sample)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("RepartitionByExpression [_shard") < plan.index("MapInArrow")


def test_parts_of_a_text():
    text = " a  b\tcé d\n "
    assert mixing.part(text, 0, 2) == " a  b" and mixing.part(text, 2, 2) == "cé d\n " and mixing.part(text, 1, 1) == "b"


def test_a_large_source_is_summed_in_levels(spark):
    rows = spark.range(3000).selectExpr("'g' AS g", "id % 37 * 64 + id % 5 AS bucket", "id", "id % 11 AS size")
    found = {r["id"]: r["off"] for r in common.exclusive_offsets(rows, "g", "bucket", ["id"], "size", "off", 12).collect()}
    total = 0
    for r in sorted(rows.collect(), key=lambda r: (r["bucket"], r["id"])):
        assert found[r["id"]] == total
        total += r["size"]


# 9 -------------------------------------------------------------------------------


def test_best_cut():
    assert importance.best_cut([3.0, 4.0], [1.0, 2.0]) == 2.5
    assert importance.best_cut([], [1.0]) == importance.best_cut([1.0], []) == float("-inf")
    assert importance.best_cut([1.0, 1.0], [1.0]) == float("-inf")


def test_top_key(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 5.0, rng.gauss(0, 1e6)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 10, 1500, 3000):
        assert importance.top_key(df, "v", k, bins=8, few=20) == sorted(values, reverse=True)[k - 1]


def test_importance_parts_good_from_poor(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    data, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) for _ in range(60)) if good else " ".join(rng.choice(words) + "%%%" for _ in range(60))
        data.append((i, text))
        if i < 150:
            labels.append((i, int(good)))
    docs, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in importance.resample(docs, known).collect()}
    held = [i for i in range(150, 300)]
    assert sum(got[i] == (i % 4 != 0) for i in held) / len(held) > 0.97
    weights = {r["doc_id"]: r["log_weight"] for r in importance.resample(docs, known).collect()}
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, t in data:
        b = np.bincount(importance.buckets(t.encode()), minlength=importance.BUCKETS)
        raw += b
        if i < 150 and i % 4:
            target += b
    share = lambda c: np.log((c + 1) / (c.sum() + importance.BUCKETS))
    ratio = share(target) - share(raw)
    for i, t in data[:40]:
        assert weights[i] == pytest.approx(ratio[importance.buckets(t.encode())].sum())


def test_kept_rows_are_the_top_of_the_noisy_weights(spark, sample):
    """As many rows as reach the cut, the first by noisy weight; equal however the rows are dealt."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    hot = sample.unionByName(sample.where("doc_id % 10 = 1"))
    got = importance.resample(hot, labels).collect()
    good = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    weights = {r["doc_id"]: r["log_weight"] for r in got}
    both = [[weights[k] for k, q in good.items() if k in weights and (q == 1) == side] for side in (True, False)]
    cut = importance.best_cut(*both)
    k = sum(r["log_weight"] >= cut for r in got)
    least = sorted((r["gumbel_key"] for r in got), reverse=True)[k - 1]
    assert 0 < k < len(got) and all(r["kept"] == (r["gumbel_key"] >= least) for r in got)
    again = importance.resample(hot.repartition(5), labels).collect()
    plain = lambda rows: Counter((r["doc_id"], r["kept"]) for r in rows)
    assert plain(again) == plain(got)


def test_importance_of_odd_documents(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert importance.resample(odd_documents, none).where("kept").count() == 11
    some = spark.createDataFrame([(6, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = importance.resample(odd_documents, some)
    assert got.count() == 11 and got.where("log_weight is null").isEmpty()
    assert importance.resample(odd_documents.limit(0), some).isEmpty()


# 2 -------------------------------------------------------------------------------


def test_fixity_finds_what_differs(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'x' * (i % 7)}{i}</p>") for i in range(700)], "page_id long, url string, html string")
    master = warc_fixity.records(pages, span=256)
    hurt = warc_fixity.damaged(master, 97)
    got = {r["page_id"]: r["status"] for r in warc_fixity.audit(master, hurt).collect()}
    assert got == {i: "corrupt" if i % 97 == 0 else "ok" for i in range(700)}
    short = Counter(r["status"] for r in warc_fixity.audit(master, master.where("key < 690")).collect())
    assert short == {"ok": 690, "missing": 10}
    more = Counter(r["status"] for r in warc_fixity.audit(master.where("key < 690"), master).collect())
    assert more == {"ok": 690, "extra": 10}


def plain_audit(master, replica):
    """How many records of each (key, url) have which status, from the multisets of their bytes."""
    one, two = Counter(master), Counter(replica)
    out = Counter()
    for key, url in {(k, u) for k, u, _ in [*one, *two]}:
        here = Counter({p: n for (k, u, p), n in one.items() if (k, u) == (key, url)})
        there = Counter({p: n for (k, u, p), n in two.items() if (k, u) == (key, url)})
        lost, new = (here - there).total(), (there - here).total()
        pairs = min(lost, new)
        out += Counter({(key, "ok"): (here & there).total(), (key, "corrupt"): pairs, (key, "missing"): lost - pairs, (key, "extra"): new - pairs})
    return out


def test_fixity_against_brute_force(spark):
    """Damage, loss, insertion and longer records in the middle, also among repeated rows: each is one finding."""
    rng = random.Random(9)
    pages = [(rng.choice([None, 5, *range(300)]), rng.choice(["u", "v", None]), rng.choice(["", "a", "bé", "c" * 50])) for _ in range(500)]
    master = warc_fixity.records(spark.createDataFrame(pages, "page_id long, url string, html string"), span=64)
    rows = [tuple(r) for r in master.collect()]

    def harm(row):
        archive, key, url, payload = row
        kind = rng.randrange(12)
        payload = bytes(payload)
        return {0: [], 1: [row, row], 2: [(archive, key, url, payload + b"!")], 3: [(archive, key, url, payload[:-9])], 4: [row, (archive, key, url, b"new")]}.get(kind, [row])

    replica = [x for row in rows for x in harm(row)]
    got = warc_fixity.audit(master, spark.createDataFrame(replica, "archive long, key long, url string, payload binary")).collect()
    plain = lambda rows: [(k, u, bytes(p)) for _, k, u, p in rows]
    assert Counter((r["page_id"], r["status"]) for r in got) == plain_audit(plain(rows), plain(replica))
    for archive in {r["archive"] for r in got}:  # the master's records lie end to end
        lie = sorted((r["place"], r["begin"], r["length"]) for r in got if r["archive"] == archive and r["status"] != "extra")
        assert [p for p, _, _ in lie] == list(range(len(lie))) and all(a[1] + a[2] == b[1] for a, b in zip(lie, lie[1:]))


@pytest.mark.parametrize("change", ["lost", "shorter", "added"])
def test_one_change_is_one_finding(spark, change):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    master = warc_fixity.records(pages)
    replica = {
        "lost": master.where("key != 100"),
        "shorter": master.withColumn("payload", F.when(F.col("key") == 100, F.expr("substring(payload, 1, 30)")).otherwise(F.col("payload"))),
        "added": master.union(master.where("key = 100").selectExpr("archive", "key", "'other' AS url", "payload")),
    }[change]
    found = Counter(r["status"] for r in warc_fixity.audit(master, replica).collect())
    assert found == {"lost": Counter(ok=299, missing=1), "shorter": Counter(ok=299, corrupt=1), "added": Counter(ok=300, extra=1)}[change]


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i % 200, f"http://h/{i}", f"<p>{'x' * (i % 7)}\r\n\r\né{i}</p>") for i in range(300)] + [(None, None, None)], "page_id long, url string, html string")
    master = warc_fixity.records(pages, span=64)
    warc_fixity.write_warc(master, f"{tmp_path}/warc")
    back = warc_fixity.read_warc(spark, f"{tmp_path}/warc")
    plain = lambda df: Counter((r["archive"], r["key"], r["url"], bytes(r["payload"])) for r in df.collect())
    assert plain(back) == plain(master)
    assert {r["status"] for r in warc_fixity.audit(master, back).collect()} == {"ok"}
    head, message = plain(master).most_common(1)[0][0][3].split(b"\r\n\r\n", 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= set(fields) and int(fields[b"Content-Length"]) == len(message) - 4


def test_fixity_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "x"), (2, "u", ""), (2, "u", ""), (3, "u", "é" * 5000), (-5, "u", "y")], "page_id long, url string, html string").selectExpr("*", "1 AS archive", "2 AS place", "'z' AS payload")
    master = warc_fixity.records(pages)
    rows = warc_fixity.audit(master, master).collect()
    assert len(rows) == 6 and {r["status"] for r in rows} == {"ok"}
    assert warc_fixity.audit(master.limit(0), master.limit(0)).isEmpty()
    assert warc_fixity.audit(master.limit(0), master).count() == 6


# queries and the pipeline ---------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == expected


def test_workers_keep_the_caches_of_one_operator(spark):
    df = spark.createDataFrame([(i, f"words of text {i}") for i in range(64)], "doc_id long, text string").repartition(16).cache()

    def held(batches):
        from credence.llm import importance, sentencepiece_bpe

        for batch in batches:
            both = importance._words.cache_info().currsize and sentencepiece_bpe._words.cache_info().currsize
            yield pa.RecordBatch.from_arrays([pa.array([int(bool(both))], pa.int64())], ["both"])

    importance.weigh(df, np.zeros(importance.BUCKETS)).collect()
    sentencepiece_bpe.round_trip(df, tokenizer("piece_bpe_32k.model")).collect()
    assert {r["both"] for r in df.mapInArrow(held, "both long").collect()} == {0}


def test_begin_empties_the_caches_of_others(monkeypatch):
    monkeypatch.setattr(common, "_at_work", None)
    one, two = common.worker_cache(lambda k: [k]), common.worker_cache(lambda k: [k])
    try:
        common.begin("one", one)
        first = one(1)
        common.begin("one", one)
        assert one(1) is first
        common.begin("two", two)
        assert not one.cache_info().currsize and two(1) is two(1)
    finally:
        common._kept_in_worker.remove(one)
        common._kept_in_worker.remove(two)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns, start = [], docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = common.materialise(stage(spark, docs, SF), "test-stage")
        names.append(name)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_dedup":
            groups = plain_copies([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(groups.values()))
        if name == "pii":
            assert docs.where(F.col("text").rlike(r"[a-z0-9]@mail\d?\.example")).isEmpty() and docs.count() == before.count()
    assert names == ["quality", "near_dedup", "pii", "mixing", "tokens"] and start.count() > 0
    assert docs.where(F.size("ids") != F.col("n_tokens")).isEmpty() and not docs.isEmpty()


def test_pipeline_on_odd_documents(spark, odd_documents):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SF), "test-odd")
    assert not docs.isEmpty()
    empty = odd_documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = common.materialise(stage(spark, empty, SF), "test-none")
    assert empty.isEmpty()


# near copies -----------------------------------------------------------------------


def plain_copies(data, width=5, similarity=0.8):
    """Least number of each row's component, by comparing all pairs."""
    sets = []
    for _, text in data:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= similarity
    pairs = [(data[i][0], data[j][0]) for i in range(len(data)) for j in range(i) if alike(sets[i], sets[j])]
    return united([k for k, _ in data], pairs)


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def planted():
    """Copies with 1 to 5 of 200 words changed, a large group of them, chains of copies of copies, and texts that share a passage."""
    rng, data = random.Random(4), []
    bases = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(30)]
    for b in bases:
        data += [changed(rng, b, n) for n in (0, 0, 1, 2, 3, 4, 5)]
    data += [changed(rng, bases[0], rng.randrange(1, 7)) for _ in range(80)]
    for _ in range(5):
        words = bases[1]
        for _ in range(6):
            words = changed(rng, words, 3).split()
            data.append(" ".join(words))
    data += [" ".join(bases[2][:100] + [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(10, 80))]) for _ in range(40)]
    data += [None, "", " \t", "one two", "ONE  two", "one two three"]
    return list(enumerate(data))


@pytest.mark.parametrize(("rounds", "small"), [(3, 64), (1, 2)])
def test_similar_texts(spark, monkeypatch, sample, rounds, small):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "SMALL", small)
    for data in (planted(), [(r["doc_id"], r["text"]) for r in sample.collect()]):
        found = simhash.similar_texts(spark.createDataFrame(data, "row long, text string"))
        assert Counter(tuple(r) for r in found.collect()) == Counter(plain_copies(data).items())
    assert simhash.similar_texts(spark.createDataFrame([], "row long, text string")).isEmpty()


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Also where keys repeat or are null: the rows of a hot key are told apart."""
    data = planted()
    rows = [(None if i % 5 == 0 else 7 if i % 3 == 0 else i, text) for i, text in data]
    out = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    groups = {}
    for i, c in plain_copies(data).items():
        groups.setdefault(c, []).append(rows[i])
    assert len(out) == len(groups)
    left = Counter(out)
    for members in groups.values():
        least = min((k for k, _ in members if k is not None), default=None)
        assert sum(n for r, n in left.items() if r in set(members)) == 1
        assert any(left[m] for m in members if m[0] == least)


def test_quality_decides_by_row(spark, sample):
    """Rows that share a key with a kept one, or have none, are kept for their own weight alone."""
    hot = sample.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 1001).when(F.col("doc_id") % 7 != 1, F.col("doc_id")).cast("long"))
    hot = common.materialise(hot.unionByName(hot.where("doc_id = 1001")), "test-hot")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights = importance.resample(hot, labels, row=None).where("kept").groupBy("doc_id", F.round("log_weight", 6).alias("w")).count()
    expected = Counter({(r["doc_id"], r["w"]): r["count"] for r in weights.collect()})
    out = corpus_pipeline.quality(spark, hot, SF)
    ratio = importance.fit(hot, set(importance.labelled_sample(labels)[0]))
    found = Counter((r["doc_id"], r["w"]) for r in importance.weigh(out, ratio).select("doc_id", F.round("log_weight", 6).alias("w")).collect())
    assert found == expected and 0 < sum(found.values()) < hot.count()
    assert 0 < sum(n for (k, _), n in found.items() if k == 1001) < hot.where("doc_id = 1001").count()
