"""Centroid clustering, WARC archives and collocations against brute force."""
import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard

from takt.llm import centroids, collocations, near_copies, warc

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, v string"


def plain_clusters(rows, clusters, rounds, dimensions, scale=64):
    """vec_id, cluster, distance by all distances in Python integers."""
    def fine(v):
        return v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [max(-2**62, min(2**62, math.floor(x * scale))) for x in v]) for i, v in rows if fine(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:clusters]]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        best = place()
        for k in range(len(centers)):
            mine = [v for (_, v), (_, c) in zip(kept, best) if c == k]
            if mine:
                centers[k] = [sum(col) // len(mine) for col in zip(*mine)]
    best = place()
    top = 2**63 - 1
    return sorted(((i, c, min(d, top), min(sum(x for x, k in best if k == c), top), min(sum(x for x, _ in best), top),
                    hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, best)), key=str)


def clustered(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], VECTORS)
    return sorted((tuple(r)[:6] for r in centroids.clustered(df, **settings).collect()), key=str)


def test_clusters_equal_all_distances(spark):
    draw = random.Random(5)
    hearts = [[draw.gauss(0, 3) for _ in range(4)] for _ in range(6)]
    rows = [(i, [h + draw.gauss(0, 0.2) for h in hearts[0 if i % 3 == 0 else i % 6]]) for i in range(240)]
    rows += [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan")] * 4), (505, [float("inf")] + [0.0] * 3)]
    rows += [(None, [0.5] * 4), (None, [0.5] * 4), (7, rows[7][1]), (7, [9.0] * 4), (600, [0.0] * 4), (601, [0.0] * 4), (602, [-0.0] * 4)]
    for rounds in (0, 1, 5):
        assert clustered(spark, rows, clusters=5, rounds=rounds, dimensions=4) == plain_clusters(rows, 5, rounds, 4)


def test_clusters_of_few_equal_and_huge_vectors(spark):
    assert clustered(spark, []) == [] and clustered(spark, [(1, None), (2, [1.0])]) == []
    few = [(3, [1.0, 2.0]), (9, [1.0, 2.0])]
    assert clustered(spark, few, clusters=16, dimensions=2) == plain_clusters(few, 16, 3, 2)
    for size in (1e5, 3e7, 1e12, 1e300):  # grid values beyond 2**22, 2**27, and 2**62
        huge = [(i, [size * (i % 7 - 3), size / (i + 1), 0.3 * i]) for i in range(40)]
        assert clustered(spark, huge, clusters=4, rounds=2, dimensions=3) == plain_clusters(huge, 4, 2, 3)


def test_bounds_spare_scans_of_settled_clusters(spark):
    draw = random.Random(6)
    rows = [(i, [20.0 * (i % 4) + draw.gauss(0, 0.3) if d == i % 4 else draw.gauss(0, 0.3) for d in range(8)]) for i in range(400)]
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], VECTORS)
    got = centroids.clustered(df, clusters=4, rounds=4, dimensions=8).collect()
    assert sum(r["scans"] for r in got) < 0.9 * 5 * len(got)


def test_loosening_holds_for_every_vector_of_the_sphere_and_is_below_the_drift():
    draw = np.random.default_rng(7)
    spared = 0
    for _ in range(200):
        before = draw.normal(size=(3, 5)) * 10
        after = before + draw.normal(size=(3, 5)) * draw.choice([0.01, 1, 10])
        radius = draw.uniform(0, 8, 3)
        got = centroids.loosening(before, after, radius)
        for a in range(3):
            x = draw.normal(size=(400, 5))
            x = before[a] + x / np.linalg.norm(x, axis=1)[:, None] * radius[a] * draw.uniform(0, 1, (400, 1)) ** 0.2
            for j in range(3):
                gain = np.linalg.norm(x - before[j], axis=1) - np.linalg.norm(x - after[j], axis=1)
                drift = np.linalg.norm(after[j] - before[j])
                assert gain.max() <= got[a, j] + 1e-9 and got[a, j] <= drift * (1 + 1e-6)
                spared += got[a, j] < 0.9 * drift
    assert spared > 500


PAGES = "page_id long, url string, html string, sha string, bucket int, first string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "y") for r in rows], PAGES)


def sha32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def page_rows():
    draw = random.Random(9)
    text = lambda n: "<p>" + " ".join(draw.choice(["alpha", "beta", "gämma", "δ", "\r\n\r\n"]) for _ in range(n)) + "</p>"
    hot = text(40)
    rows = [(i, f"https://h{i}.example/ä b?q={i}", hot if i % 3 == 0 else text(draw.randint(1, 200))) for i in range(20, 300)]
    rows += [(5, None, hot), (6, "a\r\nWARC-Type: evil", ""), (7, "", None), (8, "u", text(200_000)), (None, "v", hot), (None, "v", "only without id"), (None, None, "only without id")]
    return rows + [rows[0], rows[1], (5, "again", hot), (9, "w", "pair"), (9, "w", "pair"), (10, "w", "pair")]


def test_archives_hold_every_page_once_and_revisit_equal_payloads(spark, tmp_path):
    rows = page_rows()
    low = {}
    for page, _, html in rows:
        low[html or ""] = min(low.get(html or "", math.inf), math.inf if page is None else page)
    want = []
    for page, _, html in rows:
        first = None if low[html or ""] == math.inf else low[html or ""]
        want.append((page, len((html or "").encode()), sha32(html), "response" if page == first else "revisit", None if page == first else first))
    assert sorted(map(tuple, warc.archived(pages(spark, rows), str(tmp_path / "a")).collect()), key=str) == sorted(want, key=str)
    files = warc.write_archives(pages(spark, rows).repartition(3), str(tmp_path / "b"), least=10**6, file_bytes=20_000)
    assert files.count() > 3
    got = warc.read_archives(files).collect()
    assert sorted(((r["page_id"], bytes(r["payload"]).decode()) for r in got), key=str) == sorted(((p, h or "") for p, _, h in rows), key=str)
    assert {r["record_type"] for r in got} == {"response"}  # no payload reaches the length that revisits start from


def test_no_page_gives_no_file(spark, tmp_path):
    assert warc.archived(pages(spark, []), str(tmp_path / "none")).collect() == []


def archive(path, payloads, dictionary):
    out = warc.ArchiveWriter(str(path), dictionary)
    for i, payload in enumerate(payloads):
        out.add(warc.record(i, "https://x.example/", payload, 0, i > 0 and payload == payloads[0]))
    out.close()
    return path.read_bytes()


def test_reader_takes_the_dictionary_from_the_file_and_rejects_what_is_broken(tmp_path):
    draw = random.Random(3)
    payloads = [("<html>" + " ".join(draw.choice(["one", "two", "three", "four"]) for _ in range(300))).encode() for _ in range(200)]
    payloads.append(payloads[0])
    learned = zstandard.train_dictionary(4096, payloads, k=200, d=8).as_bytes()
    whole = archive(tmp_path / "whole.warc.zst", payloads, learned)
    plain = archive(tmp_path / "plain.warc.zst", payloads, None)
    assert struct.unpack("<I", whole[:4])[0] == warc.DICTIONARY_FRAME and plain[:4] == warc.FRAME
    for name in ("whole", "plain"):
        read = list(warc.ArchiveReader(str(tmp_path / f"{name}.warc.zst")).records())
        assert [r["payload"] for _, r in read] == [*payloads[:-1], None]
        assert read[-1][1]["record_type"] == "revisit" and read[-1][1]["payload_bytes"] == len(payloads[0]) and read[-1][1]["refers_to"] == 0
        raw = (tmp_path / f"{name}.warc.zst").read_bytes()
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learned) if name == "whole" else None)
        at = read[7][0]  # one record alone, by its offset
        assert warc.parsed(unpack.decompressobj().decompress(raw[at:]))["payload"] == payloads[7]
    size = struct.unpack("<I", whole[4:8])[0]
    raw_dictionary = struct.pack("<II", warc.DICTIONARY_FRAME, len(learned)) + learned + whole[8 + size:]
    (tmp_path / "raw").write_bytes(raw_dictionary)  # an uncompressed dictionary is allowed
    assert len(list(warc.ArchiveReader(str(tmp_path / "raw")).records())) == 201
    other = zstandard.train_dictionary(4096, [p[::-1] for p in payloads], k=200, d=8, dict_id=77).as_bytes()
    for bad in (whole[:-9], whole[:8 + size // 2], struct.pack("<II", warc.DICTIONARY_FRAME, 5) + b"hello" + whole[8 + size:], whole[8 + size:], whole + b"rest",
                struct.pack("<II", warc.DICTIONARY_FRAME, len(other)) + other + whole[8 + size:], whole[:8 + size + 40] + b"\0\0\0\0" + whole[8 + size + 44:]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            list(warc.ArchiveReader(str(tmp_path / "bad")).records())


def test_records_with_wrong_headers_or_lengths_are_errors():
    good = warc.record(3, "https://x.example/", b"abc", 1, False)
    assert warc.parsed(good)["payload"] == b"abc"
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 3", b"Content-Length: 4"), (b"WARC-Date", b"WARC-Day"), (b"abc", b"abd"), (b"response", b"metadata"),
                     (b"WARC-Type:", b"WARC-Type"), (b"\r\nWARC-Date", b"\r\nWARC-Type: response\r\nWARC-Date"), (b"urn:x-page:3", b"urn:3")):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(good.replace(old, new, 1))
    for cut in (good[:-1], good + b"x", good[:40]):
        with pytest.raises(ValueError):
            warc.parsed(cut)


def plain_collocations(rows, least, longest, top):
    """Everything by lists of words and Python integers."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {p: f for p, f in counts.items() if f >= least and len(p[1]) > 1}
    inside = {(lang, p[i:i + k]) for (lang, p), f in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
              if 100 * f >= 100 * counts[lang, p[i:i + k]]}
    out = []
    for (lang, p), a in frequent.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], n[lang], k))
    out.sort()
    rank, made = Counter(), []
    for lang, score, a, phrase, left, right, total, k in out:
        rank[lang] += 1
        if rank[lang] <= top:
            made.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score, k))
    return made


def phrase_rows():
    draw = random.Random(12)
    vocabulary = ["the", "The", "of", "naïve", "Ünder", "x\u0085y", "日本", "z\x1cq", "new", "york", "a", "b"]
    common = "the united states of america and the people"
    rows = []
    for i in range(150):
        words = [draw.choice(vocabulary) + draw.choice(["", "", "", ",", ".", "\n", "\x0b", "?!"]) for _ in range(draw.randint(0, 60))]
        rows.append((["en", "en", "de", None, "und", "pt br", ""][i % 7], " ".join(words).replace("a ", "a\t ") + (" " + common if i % 3 == 0 else "")))
    rows += [("en", "the " * 3000), ("en", "New York, new york. " * 700), ("de", None), ("de", ""), ("de", " .\n"), (None, "only once"), ("en", "of " + "x" * 5000)]
    return rows + rows[:9]


@pytest.mark.parametrize("settings", [{}, {"range_bytes": 300, "chunk": 97}, {"range_bytes": 3000, "chunk": 4}])
def test_collocations_equal_plain_counts(spark, settings):
    rows = phrase_rows()
    df = spark.createDataFrame([(None if i % 9 == 0 else i, t, lang, "s", 1, 2, 3) for i, (lang, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, phrase string, part int, f int, n int").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least=6, top=40, **settings).collect()))
    assert got == sorted(plain_collocations(rows, 6, 5, 40))


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(df).collect() == []


def test_text_in_blocks_is_the_whole_text():
    text = "Aa bb, cc\tdd " * 50 + "y" * 300 + " end"
    whole = [t for part in collocations.split_words(text, 10**9) for t in part]
    for size in (1, 7, 64, 1000):
        assert [t for part in collocations.split_words(text, size) for t in part] == whole


def test_scores_pass_64_bits(spark):
    rows = [(9 * 10**14 + i, 8 * 10**15, 9 * 10**14 + 7 * i, 10**15 + i) for i in range(5)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(collocations.score("a", "n", "l", "r").alias("s")).collect()
    assert [r["s"] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_automata_keep_paths_and_weights():
    draw = np.random.default_rng(2)
    words = [b"w%02d" % i for i in range(30)]
    rows = collocations.paths_of(np.where(draw.random(4000) < 0.1, -1, draw.integers(0, 30, 4000)).astype(np.int32), 4)
    rows = rows[rows[:, 0] >= 0]
    paths, weights = collocations.merged(rows, np.ones(len(rows), np.int64), 30)
    want = Counter(map(tuple, rows.tolist()))
    assert {tuple(p): w for p, w in zip(paths.tolist(), weights.tolist())} == want and list(map(tuple, paths.tolist())) == sorted(want)
    half = len(paths) // 2
    parts = [collocations.dump(words, paths[a:b], weights[a:b]) for a, b in ((0, half), (half, len(paths)), (half // 2, half))]
    made = collocations.united(parts)
    twice = want + Counter({tuple(p): w for p, w in zip(paths[half // 2:half].tolist(), weights[half // 2:half].tolist())})
    back = {tuple(int(made.words[i][1:]) if i >= 0 else -1 for i in p): w for p, w in zip(made.paths.tolist(), made.run(made.paths).tolist())}
    assert back == twice
    assert sum(made.levels[0][3]) == sum(twice.values())
    assert made.run(np.array([[29, 29, 29, 29], [len(made.words), -1, -1, -1]], np.int32)).tolist() == [twice.get((29, 29, 29, 29), 0), 0]


def _rare_case(spark, rows):
    """rows: name -> (set, class, center, off), all of positive numbers; as near_copies takes them."""
    sets = spark.createDataFrame([(s, sorted(made)) for s, (made, *_) in rows.items()], "shape long, made array<long>")
    grouped = spark.createDataFrame([(s, *at) for s, (_, *at) in rows.items()], "shape long, class long, center long, off double")
    order = near_copies.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0.8)
    return near_copies.settled(near_copies._rare_parts(sets, grouped, order)), near_copies.settled(sets)


def test_r3_pipeline_a_text_meets_the_hub_of_a_group_not_all_of_it(spark, monkeypatch):
    asked, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *a: (asked.append(pairs.count()), verified(pairs, *a))[1])
    base = set(range(100))
    for n in (20, 60):
        rows = {1: (base, 1, 1, 0.0)} | {10 + i: (base - {99 - i} | {1_000_000 + i}, 1, 1, 2 / 101) for i in range(n)}
        for z in range(3):  # 87 of 113 in common, the rest with the same bits: no bound but the distance tells them from the group's texts
            rows[500 + z] = (set(range(87)) | {512 * (z + 1) * 1000 + i for i in range(13)}, 500 + z, 500 + z, 0.0)
        asked.clear()
        parts, sets = _rare_case(spark, rows)
        assert near_copies._rare_links(parts, sets, 0.8, 0.8).count() == 0
        assert sum(asked) == 3 + 3  # each text with the hub and with the two others, whatever n


def test_r3_pipeline_links_past_the_hub_are_found(spark):
    base = set(range(100))
    far = set(range(90)) | set(range(1000, 1010))
    further = set(range(80)) | set(range(1000, 1010)) | set(range(2000, 2010))
    parts, sets = _rare_case(spark, {1: (base, 1, 1, 0.0), 2: (far, 1, 1, 20 / 110), 3: (further, 3, 3, 0.0)})
    assert [(r.a, r.b) for r in near_copies._rare_links(parts, sets, 0.8, 0.8).collect()] == [(2, 3)]  # 1 and 3 are no pair: 80 of 120


def test_components_of_few_edges_take_few_tasks(spark):
    """With many shuffle partitions, a round on few edges must not write files and log entries for all of them in each of its stages."""
    from takt.llm.components import components

    sc, partitions = spark.sparkContext, 101
    held = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    edges = [(10, i) for i in range(11, 200)] + [(i, i + 1) for i in range(300, 312)] + [(500, 500), (199, 9), (10, 11)]
    for k, v in held.items():
        spark.conf.set(k, v)
    sc.setJobGroup("few edges", "")
    try:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {9: 9} | {i: 9 for i in range(10, 200)} | {i: 300 for i in range(300, 313)}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few edges") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert 0 < tasks < 25 * partitions, tasks  # 6,579 before, 1,526 now


def test_few_tasks_read_all_rows(spark):
    from takt.llm.common import few_tasks

    cores, rows = spark.sparkContext.defaultParallelism, spark.range(0, 10_000, 1, 97)
    for at_once, tasks in ((10, 97), (200, max(cores, 50)), (10_000, cores)):
        few = few_tasks(rows, 10_000, at_once)
        assert few.rdd.getNumPartitions() == min(97, tasks)
        assert sorted(r.id for r in few.collect()) == list(range(10_000))
