"""Source audit, centroid clustering and SimHash groups against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from flowspark.llm import centroids, common, simhash, source_audit

TINY = "/root/testdata/sf0.001"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op11 -------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))) for lang, source, text in rows]
    in_docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        in_docs[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]

        def shares(found):
            total = sum(found[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (found[t] + 5) // total for t in kept}

        p = shares(counts)
        q = shares(sum((c for (g, _), c in groups.items() if g == lang), Counter()))
        pairs = []
        for (other_lang, other), found in groups.items():
            if other_lang == lang and other != source:
                theirs = shares(found)
                pairs.append((sum(abs(p[t] - theirs[t]) for t in kept), other))
        terms = [(p[t] - q[t], t) for t in kept if counts[t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, i, v, k + 1) for k, (v, i) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def audited(df, **options):
    found = source_audit.audit_sources(df, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


def _texts(seed, n, words=40):
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ab", "cé", "中", "x", "ΑΣ") for b in "abcdefgh"]
    rows = []
    for k in range(n):
        text = " 1,".join(draw.choices(vocabulary, [1 + (k + j) % 7 for j in range(len(vocabulary))], k=draw.randint(0, words)))
        rows.append((draw.choice(["en", "de", None, "x\0y"]), draw.choice(["s1", "s2", "S\0", None, ""]), text))
    return rows


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_audit_against_plain(spark, monkeypatch, pass_bytes):
    rows = _texts(1, 300) + [("zz", "lone", None), ("zz", "two", ""), ("en", "s1", "ab" * 50_000 + " Zab"), ("nn", "one", "rare words only")]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("shard", common.F.lit("clash")).withColumn("counts", common.F.lit(0)).repartition(7)
    monkeypatch.setattr(source_audit, "SHARD_TERMS", 8)
    monkeypatch.setattr(source_audit, "BLOCK", 2)
    monkeypatch.setattr(source_audit, "FAN_IN", 2)
    monkeypatch.setattr(source_audit, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(source_audit, "DENSE_BYTES", 200)
    assert audited(docs, min_docs=6, top=4, pass_bytes=pass_bytes) == plain_audit(rows, 6, 4)


def test_audit_of_no_rows_and_no_kept_terms(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert audited(none) == []
    rows = [("en", "b", "one two"), ("en", "a", None), ("en", "c", "Two"), (None, None, "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(docs) == plain_audit(rows, 30, 50)
    assert {r[4] for r in audited(docs)} == {0}


def test_perfect_hashes_are_minimal_and_verified():
    draw = np.random.default_rng(3)
    for n in (1, 2, 17, 5_000):
        hashes = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        levels, slots = source_audit.perfect_hash(hashes)
        assert sorted(slots.tolist()) == list(range(n))
    # Three terms of one hash have no level; they are told apart by their stored names.
    same = np.array([5, 5, 5, 9], np.uint64)
    levels, slots = source_audit.perfect_hash(same)
    names = np.array(["a", "b", "c", "d"], object)[np.argsort(slots)]
    shard = source_audit.Shard(b"".join(np.packbits(b).tobytes() for b in levels), [len(b) for b in levels], "\n".join(names).encode())
    asked = pa.array(["a", "b", "c", "d", "e", "f"])
    found = shard.slots(np.array([5, 5, 5, 9, 5, 9], np.uint64), asked)
    assert found[:4].tolist() == slots.tolist() and found[4:].tolist() == [-1, -1]


def test_shares_are_exact_for_large_counts():
    draw = random.Random(4)
    for _ in range(300):
        counts = [draw.randrange(10 ** draw.randint(1, 14)) for _ in range(5)]
        total = sum(counts) + 25
        assert source_audit.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 5) // total for c in counts]


# --- op12 -------------------------------------------------------------------------------


def plain_clusters(rows, dimensions, scale, clusters, rounds, seed):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            distances = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, v, distances.index(min(distances)), min(distances)))
        return out

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, at, _ in assign():
            held[at].append(v)
        for at, vectors in held.items():
            centres[at] = [sum(c) // len(vectors) for c in zip(*vectors)]
    last = assign()
    of = Counter()
    for _, _, at, d in last:
        of[at] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, at, d, of[at], sum(of.values()), digest[at]) for i, _, at, d in last), key=repr)


@pytest.mark.parametrize("spread,scale", [(1.0, 64), (3.0e5, 64), (0.02, 8)])
def test_clusters_against_plain(spark, monkeypatch, spread, scale):
    monkeypatch.setattr(centroids, "BLOCK", 9)
    draw = random.Random(5)
    rows = []
    for k in range(150):
        middle = draw.choice([(0, 0, 0, 0, 0), (1, 1, 0, 0, 2), (-2, 0, 1, 0, 0)])
        rows.append((k, [float(np.float32(spread * draw.gauss(m, 0.4))) for m in middle]))
    rows += [(200, None), (201, []), (202, [1.0] * 4), (203, [1.0, None, 0.0, 0.0, 0.0]), (204, [float("nan")] + [0.0] * 4), (205, [float("inf")] + [0.0] * 4)]
    rows += [(None, [0.5] * 5), rows[0], rows[1], (300, rows[2][1]), (301, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cluster", common.F.lit("clash")).withColumn("v", common.F.lit(0)).repartition(5)
    found = centroids.cluster_vectors(df, dimensions=5, scale=scale, clusters=6)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_clusters(rows, 5, scale, 6, 3, 1)


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert centroids.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster_vectors(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    rows = [(k, [0.25] * 64) for k in range(40)]
    found = centroids.cluster_vectors(spark.createDataFrame(rows, schema))
    assert {tuple(r)[1:5] for r in found.collect()} == {(0, 0, 0, 0)}
    with pytest.raises(ValueError):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], schema))


def test_hilbert_curve_goes_from_cell_to_neighbouring_cell():
    for dimensions, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
        keys = centroids.hilbert_keys(cells, bits)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    draw = np.random.default_rng(6)
    pruned = 0
    for _ in range(200):
        points, centres = draw.integers(-20, 20, (30, 3)) + draw.integers(-40, 40, 3), draw.integers(-60, 60, (8, 3))
        able = centroids.candidates(points.min(axis=0), points.max(axis=0), centres)
        at, _ = centroids.nearest(points, centres, True)
        assert set(at.tolist()) <= set(able.tolist())
        assert (centroids.nearest(points, centres, False)[0] == at).all()
        pruned += len(centres) - len(able)
    assert pruned > 200


# --- op13 -------------------------------------------------------------------------------


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, limit=4):
    """Index of the first member of each print's group, by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= limit:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def test_simhash_against_plain(spark):
    rows = [(k, t) for k, t in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "Two words"), (-5, "two  WORDS"), (-6, "É é a b"), (None, "no id"), rows[0], (10**6, "lang wort " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("print", common.F.lit("clash")).withColumn("component", common.F.lit(0)).repartition(6)
    found = simhash.group_simhash(df).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = defaultdict(list)
    for (key, _), group in zip(rows, plain_groups(prints)):
        groups[group].append(key)
    least = [min((k for k in groups[g] if k is not None), default=None) for g in plain_groups(prints)]
    want = [(key, f"{p:016x}", c) for (key, _), p, c in zip(rows, prints, least)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert simhash.group_simhash(df.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [8192, 20])
def test_links_join_what_all_pairs_join(spark, monkeypatch, largest):
    """Random prints, chains, dense clusters, pairs at 4 and 5 bits; also where every cell of some size is cut."""
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", 64)
    draw = random.Random(8)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        start = draw.getrandbits(64)
        prints.add(start)
        for bits in (1, 2, 3, 4, 5):
            prints.add(start ^ sum(1 << b for b in draw.sample(range(64), bits)))
    for _ in range(40):
        last = draw.getrandbits(64)
        for _ in range(4):
            last ^= sum(1 << b for b in draw.sample(range(64), 4))
            prints.add(last)
    dense = draw.getrandbits(64)
    prints |= {dense ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for _ in range(150)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(5)
    links = simhash.print_links(df, 4, largest).collect()
    known = dict(zip(signed, prints))
    assert all(bin(known[r.a] ^ known[r.b]).count("1") <= 4 for r in links)
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    mine = defaultdict(set)
    for p in signed:
        mine[find(p)].add(known[p])
    theirs = defaultdict(set)
    for p, group in zip(prints, plain_groups(prints)):
        theirs[group].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_half_bits_are_not_set():
    assert simhash.fingerprint(b"a b c d e") == plain_fingerprint("a b c d e")
