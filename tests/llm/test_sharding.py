import hashlib
import zlib
from collections import Counter

import numpy as np

from marketloom.llm import sharding


def plain_jump(key, shards):
    """The published method, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def test_jump_against_one_key_at_a_time():
    keys = np.random.default_rng(1).integers(0, 2**63, 2000)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_growth_moves_only_the_necessary_share_and_only_into_new_shards():
    keys = np.random.default_rng(2).integers(0, 2**60, 40_000)
    for shards in (1, 7, 16, 100):
        a, b = sharding.jump(keys, shards), sharding.jump(keys, shards + 1)
        went = a != b
        assert (b[went] == shards).all()
        assert abs(went.mean() - 1 / (shards + 1)) < 0.01
        assert Counter(a.tolist()).most_common()[-1][1] > 0.7 * len(keys) / shards


def brute(rows):
    found = []
    for d, t, *_ in rows:
        body = (t or "").encode()
        found.append((plain_jump(key_of(d), 16), d is not None, d or 0, zlib.crc32(body), len(body) + 1, d, plain_jump(key_of(d), 17)))
    out, seen = [], Counter()
    for shard, _, _, crc, size, d, grown in sorted(found, key=lambda r: r[:5]):
        out.append((d, size, crc, "key", shard, seen[shard], grown))
        seen[shard] += 1
    return sorted(out, key=str)


def test_documents_against_brute_force(docs, corpus, spark):
    assert sorted(map(tuple, sharding.shard_documents(docs).collect()), key=str) == brute(corpus)
    odd = [(None, "a"), (None, "a"), (None, None), (4, "x"), (4, "x"), (4, ""), *[(i, "same") for i in range(100, 300)]]
    df = spark.createDataFrame(odd, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, sharding.shard_documents(df).collect()), key=str) == brute(odd)


def test_no_documents(no_docs):
    assert sharding.shard_documents(no_docs).collect() == []


def test_moved_rows_alone_bring_shards_up_to_date(docs):
    rows = docs.select("doc_id", "text")
    before = {r["doc_id"]: r["shard"] for r in sharding.assign(rows, shards=4).collect()}
    went = {r["doc_id"]: (r["shard"], r["new_shard"]) for r in sharding.moved(rows, 4, 9).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.assign(rows, shards=9).collect()}
    assert went and all(s == before[d] and n >= 4 for d, (s, n) in went.items())
    assert {d: went.get(d, (0, s))[1] for d, s in before.items()} == after


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"] for r in back.select("shard").distinct().collect()} <= {0, 1, 2}
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert all(plain_jump(key_of(r["doc_id"]), 3) == r["shard"] for r in back.collect())
