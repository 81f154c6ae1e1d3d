"""Operators over whole tables against brute force: packing, shards, mixes, near-duplicates, embeddings, token files."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from takt.llm import embedding_dedup as embeddings
from takt.llm import mixing, packing, quality_rules, sharding, simhash, token_files
from takt.llm.components import components, local_roots
from takt.llm.tokens import encoder

SYLLABLES = ["ta", "ri", "mo", "ken", "su", "la", "ver", "di", "no", "pa", "ster", "ul"]


def prose(draw, n):
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Two hundred texts: a source with a third of the rows, copies, near copies, repeated rows, a very long text, nothing."""
    draw = random.Random(8)
    rows = []
    for i in range(160):
        rows.append((i, prose(draw, draw.randint(1, 300)), "hot" if i % 3 == 0 else f"s{i % 5}"))
    long = prose(draw, 6000)
    rows += [(200, long, "s1"), (201, None, "s2"), (202, "", None), (203, " \n", None), (204, "x", "tiny"), (None, "no id", "s3")]
    rows += [(300 + i, rows[6][1], "hot") for i in range(30)]
    rows += [(400 + i, long.replace("ta", "ta", 1) + f" tail{i}", "s4") for i in range(4)]
    rows += [rows[0], rows[0], (5, "same id, other text " * 3, "s0")]
    df = spark.createDataFrame([(d, t, "en", s, len(t) if t is not None else None, 1, "z") for d, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, block int, `group` string")
    return rows, df


def test_packing_places_every_piece_once(spark, corpus):
    rows, df = corpus
    got = packing.pack_documents(df).collect()
    encode = encoder(packing.VOCABULARY).tokenizer
    expected = []
    for doc, text, _ in rows:
        ids = np.array(encode.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(doc, k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(expected, key=key)
    of = defaultdict(list)
    for r in got:
        of[r.sequence_id].append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(of) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_place_minimises_the_sum_of_squares():
    draw = random.Random(1)
    sizes = [draw.randint(1, 20) for _ in range(120)]
    number, offset = packing.place(np.array(sizes), 20)
    count, used = Counter(), Counter()
    for size, n, at in zip(sizes, number, offset):
        gap = 20 - used[n]
        assert at == used[n]

        def after(g):
            trial = Counter(count)
            if g < 20:
                trial[g] -= 1
            if g > size:
                trial[g - size] += 1
            return sum(v * v for v in trial.values())
        fits = [g for g, k in count.items() if k > 0 and g >= size]
        assert (gap == 20) == (not fits) and (not fits or after(gap) == min(map(after, fits)))
        if gap < 20:
            count[gap] -= 1
        if gap > size:
            count[gap - size] += 1
        used[n] += size


def test_shards_are_even_and_mixed(spark, corpus):
    rows, df = corpus
    got = sharding.interleaved(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(16)) and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    of_source = Counter(s for _, _, s in rows)
    seen = Counter((r.shard, r.source) for r in got)
    assert all(abs(seen[s, name] - n / 16) <= 2 for name, n in of_source.items() for s in range(16))
    sizes = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert Counter((r["size"], r.text_crc32) for r in got) == sizes
    assert sorted(map(str, got)) == sorted(map(str, sharding.interleaved(df, slices=4).collect()))
    assert sharding.interleaved(df.limit(0)).collect() == []


def test_targets_and_seats():
    share = mixing.targets([100, 10, 50, 0], [3, 1, 2, 3], 240)
    assert share[1] == 20 and share[3] == 0 and share[2] == 88 and abs(share.sum() - 240) < 1e-9
    assert all(share <= 2 * np.array([100, 10, 50, 0]) + 1e-9)
    draw = random.Random(6)
    for _ in range(60):
        want = [draw.choice([0, draw.random() * 50]) for _ in range(draw.randint(1, 7))]
        most, blocks = [draw.randint(0, 30) for _ in want], draw.randint(0, 60)
        seats = [0] * len(want)
        for _ in range(blocks):
            open_ = [(w / (2 * k + 1), -i) for i, (w, k, m) in enumerate(zip(want, seats, most)) if k < m and w > 0]
            if not open_:
                break
            seats[-max(open_)[1]] += 1
        assert mixing.apportion(np.array(want), blocks, np.array(most)).tolist() == seats


def test_mix_meets_targets_within_blocks(spark, corpus):
    rows, df = corpus
    got = mixing.mixed(df).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    taken, target, full = Counter(), {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source], full[r.source] = r.target, r.source_size
    names = sorted((s for s in full if s is not None)) + [None]
    weights = dict(zip(names, [3, 1, 2] * 5))
    free = {s for s in names if target[s] < 2 * full[s] - 1e-6}
    assert abs(sum(target.values()) - min(1.5 * sum(full.values()), 2 * sum(full.values()))) < 1e-6
    assert len({round(target[s] / weights[s], 6) for s in free}) <= 1
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS + 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(df.repartition(5)).collect()))
    df = df.withColumn("__content", F.lit("kept")).withColumn("__take", F.lit(5)).withColumn("__copy", F.lit(6))
    made = mixing.mix(df)
    assert made.columns == df.columns and made.select("__content", "__take", "__copy").distinct().collect() == [("kept", 5, 6)]
    words = Counter()
    for r in made.collect():
        words[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mixed(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []
    plan = mixing.plan(df.selectExpr("source", "size(split(text, ' ')) AS size").na.fill({"size": 0}))
    assert [sum(s[i] for s in plan.shard_blocks) for i in range(len(plan.sources))] == plan.blocks and min(map(min, plan.shard_blocks)) >= 0


def plain_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    u, inverse = np.unique(np.array(prints, np.uint64), return_inverse=True)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    return local_roots(len(u), i, j)[inverse]


def test_simhash_classes(spark, corpus):
    rows, df = corpus
    got = simhash.classes(df).collect()
    prints = [plain_print(t) for _, t, _ in rows]
    roots = plain_components(prints)
    low = {}
    for (d, _, _), r in zip(rows, roots):
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{p:016x}", low[r]) for (d, _, _), p, r in zip(rows, prints, roots))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert simhash.classes(df.limit(0)).collect() == [] and simhash.keep_first(df.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [simhash.BLOCK_PRINTS, 40])
def test_ball_hashing_connects_as_comparing_all_pairs(spark, limit):
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for center in list(prints)[:20]:
        for _ in range(8):
            prints.add(center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 6))))
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    comps = {r.node: r.component for r in components(simhash.links(df, limit)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots, found = plain_components(prints), defaultdict(set)
    for p, r in zip(signed, roots):
        found[r].add(comps.get(p, p))
    assert all(len(v) == 1 for v in found.values()) and len(set().union(*found.values())) == len(found)


def test_variants_made_part_by_part_meet_alike(monkeypatch):
    draw = random.Random(5)
    center = draw.getrandbits(64)
    prints = np.array(sorted({center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for _ in range(60)}), np.uint64)
    left = np.array([draw.randint(0, 2) for _ in prints])
    whole = local_roots(len(prints), *simhash.meet(prints, left, 64))
    monkeypatch.setattr(simhash, "AT_ONCE", 500)
    assert np.array_equal(whole, local_roots(len(prints), *simhash.chains(prints, left, 64)))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(500, i) for i in range(501, 560)] + [(600, 600), (700, 701), (701, 700), (702, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(71)} == {0} and {got[i] for i in range(500, 560)} == {500} and {got[i] for i in (700, 701, 702)} == {700} and 600 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("rows", [embeddings.BLOCK_ROWS, 40])
def test_embedding_links(spark, rows):
    draw = np.random.default_rng(4)
    hearts = draw.normal(size=(30, 12))
    x = [draw.normal(size=12) for _ in range(60)]
    for h in hearts:
        x += [h + draw.normal(size=12) * draw.choice([0.02, 0.2, 0.35]) for _ in range(8)]
    x += [x[0]] * 40 + [x[1] * 3.0, x[1] * 1e-3] + [x[2] + draw.normal(size=12) * 0.03 for _ in range(90)]
    data = [(i, v.astype(float).tolist(), 0) for i, v in enumerate(x)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [0.0] * 12, 1), (n + 2, [None] + [1.0] * 11, 1), (n + 3, [float("nan")] * 12, 1), (n + 4, [float("inf")] * 12, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: tuple(r)[1:] for r in embeddings.linked(df, block_rows=rows).collect()}
    u = np.array(x) / np.linalg.norm(np.array(x), axis=1)[:, None]
    near = u @ u.T >= 0.9
    root = local_roots(n, *np.nonzero(near))
    for i in range(n):
        assert got[i] == (int(near[i].sum()) - 1, int(root[i]), bool(root[i] == i)), i
    assert all(got[i] == (0, i, True) for i in range(n, n + 7))
    assert embeddings.linked(df.limit(0)).collect() == [] and embeddings.linked(df.where("vec_id >= " + str(n))).count() == 7


def test_token_files_round_trip(spark, corpus, tmp_path):
    rows, df = corpus
    shards = token_files.write_tokens(df, str(tmp_path), rows_a_shard=60, length=64, batch=4)
    got = sorted(token_files.read_tokens(spark, shards).collect(), key=lambda r: r.start)
    encode = encoder(token_files.VOCABULARY).tokenizer
    at, stream = 0, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for (doc, text, _), r in zip(order, got, strict=True):
        ids = np.array(encode.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        stream.append(ids)
    assert len(shards) > 1
    base = 0
    for s in shards:
        shard, whole = token_files.Shard(s["path"]), np.concatenate(stream)[base:base + s["n_tokens"]]
        for i in range(-(-len(whole) // 64)):
            ids, mask = shard.sequence(i)
            assert len(ids) == 64 and np.array_equal(ids[mask], whole[64 * i:64 * i + 64]) and not ids[~mask].any()
            assert ids.base is not None or not ids.flags.owndata
        base += s["n_tokens"]
    assert token_files.written_tokens(df.limit(0)).collect() == []


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    rows, df = corpus
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    base = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, docs.count()))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == base
    keep = quality_rules.measurer()
    assert seen[0][1] == sum(keep(t)[6] for _, t, _ in rows) > seen[1][1] == seen[2][1] > 0
    assert [n for n, _ in seen] == ["quality_rules", "simhash_dedup", "secret_scan", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.select(*base).limit(0), str(tmp_path)).collect() == []


def plain_shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_keeps_one_of_texts_at_four_fifths(spark):
    """Near copies at 0.8 to 0.95, chains, near misses, and a hub whose copies are alike only through it."""
    draw = random.Random(12)
    rows = []
    for _ in range(40):
        words = prose(draw, draw.randint(40, 200)).split()
        rows.append(" ".join(words))
        for _ in range(4):
            for at in draw.sample(range(len(words)), max(1, len(words) // draw.choice([40, 60, 80]))):
                words[at] = words[at] + "x"
            rows.append(" ".join(words))
    words = prose(draw, 200).split()
    rows.append(" ".join(words))
    for _ in range(60):
        mine = list(words)
        for at in draw.sample(range(200), 3):
            mine[at] += "q"
        rows.append(" ".join(mine))
    rows += [None, "", " ", "one two", "ONE  two"]
    sets = [plain_shingles(t) for t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i)
            if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) / (len(sets[i] | sets[j]) or 1) >= 0.8]
    far = [p for p in near if (simhash.fingerprint(rows[p[0]]) ^ simhash.fingerprint(rows[p[1]])).bit_count() > 4]
    assert len(far) > 50
    root = local_roots(len(rows), *np.array(near).T)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.stage_near_duplicates(spark, df, "").collect()}
    assert kept == set(root.tolist())


def test_near_duplicates_are_named_by_the_balls_of_fingerprints(spark, monkeypatch):
    """The stage goes through ball hashing, and pairs that only the ball names are checked and linked."""
    from takt.llm import near_copies
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"v{i}" for i in range(400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash.fingerprint(t, near_copies.SHINGLE) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    asked, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: asked.append(1) or plain(*a))
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [1, 3] and asked
