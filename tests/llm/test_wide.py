"""Operators that compare documents, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomstone.llm import decontam, minhash, mixing, sstable, suffix_dedup
from loomstone.llm.difference_cover import suffix_order
from loomstone.llm.queries import oracle_sql, queries

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_token_shards_round_trip(spark, docs, no_docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(sstable.TOKENIZER)
    directory = sstable.fresh_path(spark, "test")
    shards = sstable.write_shards(docs, directory)
    got = ordered(sstable.read_shards(spark, shards).collect())
    plain = {}
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        plain.setdefault(r[0], []).append(ids)
    assert sorted(x[0] for x in got if x[0] is not None) == sorted(r[0] for r in rows if r[0] is not None)
    sums = Counter((x[0], x[2], x[3]) for x in got)
    assert sums == Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, many in plain.items() for ids in many)
    start = 0
    for row in sorted(got, key=lambda x: (x[1])):
        assert row[1] == start
        start += row[2]
    by_start = sorted(got, key=lambda x: x[1])
    assert [x[0] is not None for x in by_start] == sorted(x[0] is not None for x in by_start)
    for doc_id, many in plain.items():
        found = [v.tolist() for path, _, _ in shards for v in sstable.ShardReader(path).lookup(doc_id)]
        assert sorted(found) == sorted(many)
    assert [v for path, _, _ in shards for v in sstable.ShardReader(path).lookup(10**9)] == []
    assert sstable.token_rows(no_docs).collect() == []


def test_shards_find_every_block_and_notice_damage(tmp_path):
    path = tmp_path / "one.sst"
    with open(path, "wb") as out:
        writer = sstable.ShardWriter(out)
        values = {i: np.random.default_rng(i + 50).integers(0, 1 << (15 + 3 * (i % 2)), 5000).astype("<u4") for i in range(-50, 50)}
        for i, v in values.items():
            writer.add(i, sstable.pack_ids(v.tobytes()))
        writer.finish()
    reader = sstable.ShardReader(f"file://{path}")
    assert len(reader.index) > 5
    for i, v in values.items():
        assert [x.tolist() for x in reader.lookup(i)] == [v.tolist()]
    raw = bytearray(path.read_bytes())
    raw[100] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.ShardReader(f"file://{path}").scan())


def test_shards_follow_the_bytes_of_texts(spark, docs, monkeypatch):
    directory = sstable.fresh_path(spark, "test")
    whole = ordered(sstable.token_rows(docs).collect())
    monkeypatch.setattr(sstable, "SHARD_BYTES", 4096)
    shards = sstable.write_shards(docs, directory)
    assert len(shards) > 4
    assert ordered(sstable.read_shards(spark, shards).collect()) == whole


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(1)
    for n in [*range(1, 30), 100, 300]:
        for letters in (1, 2, 5):
            text = rng.integers(1, letters + 1, n)
            assert suffix_order(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def removal_by_hand(rows):
    """Rows in order of place; one document for rows that repeat id and text."""
    seen, out = {}, []
    place = lambda r: (-(1 << 63) if r[0] is None else r[0], r[2])
    for r in sorted(rows, key=place):
        data, spans = (r[1] or "").encode(), []
        for k in range(len(data) - 99):
            at = (place(r), k)
            if seen.setdefault(data[k : k + 100], at) < at:
                spans.append((k, k + 100))
        runs, kept, at = suffix_dedup.merged_runs(spans), b"", 0
        for a, b in runs:
            kept, at = kept + data[at:a], b
        out.append((r[0], len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept + data[at:]).hexdigest()))
    return ordered(out)


def with_key(docs):
    return [(r["doc_id"], r["text"], r["key"]) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as key").collect()]


def test_suffix_dedup(docs, no_docs):
    assert ordered(suffix_dedup.deduplicate(docs).collect()) == removal_by_hand(with_key(docs))
    assert suffix_dedup.deduplicate(no_docs).collect() == []


def test_suffix_dedup_with_large_groups(spark, monkeypatch):
    """Few contexts allowed in a bucket: the rest meets by whole windows and gives the same."""
    rng = np.random.default_rng(8)
    common = "".join(map(chr, rng.integers(97, 123, 130)))
    filler = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(0, 150))))
    rows = [(i, filler() + common[rng.integers(0, 20) :] + filler()) for i in range(60)] + [(100, "ab" * 400), (101, "ab" * 300 + filler())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = removal_by_hand(with_key(docs))
    assert ordered(suffix_dedup.deduplicate(docs).collect()) == expected
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 3)
    assert ordered(suffix_dedup.deduplicate(docs).collect()) == expected


def by_sql(sql, columns, **tables):
    """Rows of the SQL over small tables of (id, text)."""
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    names = {"documents": "doc_id", "benchmark": "item_id"}
    for table, rows in tables.items():
        connection.execute(f"create table {table} ({names[table]} bigint, text varchar)")
        connection.executemany(f"insert into {table} values (?, ?)", [list(r[:2]) for r in rows])
    cursor = connection.execute(sql)
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    return [tuple(r[i] for i in at) for r in cursor.fetchall()]


def hits_by_hand(text, items):
    words, hit, found = re.findall(WORD, lower(text)), set(), set()
    for item_id, item in items:
        own = re.findall(WORD, lower(item))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1 if own else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item_id)
    listed = ",".join(sorted(str(i) for i in found if i is not None))
    return len(words), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark, docs, no_docs, rows, passage):
    items = [(1, passage), (2, passage.upper() + " more words behind it"), (3, "two words"), (4, ""), (5, None), (6, "D-E"), (7, "the the the the the the the the the the the the the the the"), (1, passage), (1, "another text of the same item"), (None, "the the"), (None, passage)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = ordered(decontam.verdicts(docs, benchmark).collect())
    assert got == ordered((r[0], *hits_by_hand(r[1], items)) for r in rows)
    assert decontam.verdicts(no_docs, benchmark).collect() == []
    assert ordered(by_sql(decontam.SQL, decontam.verdicts(docs, benchmark).columns, documents=rows, benchmark=items)) == got
    judged = decontam.judge(docs, benchmark)
    assert sorted(judged.columns) == sorted({*docs.columns, *decontam.VERDICT})
    assert sorted(r[0] for r in judged.select("n_words").collect()) == sorted(r[1] for r in got)
    clean = decontam.verdicts(docs, benchmark.where("false")).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)


def test_decontamination_of_repetitive_text(spark):
    item = " ".join(["x y z"] * 9)
    texts = [(1, "a b " + " ".join(["x y z"] * 40) + " c"), (2, " ".join(["x y z"] * 4)), (3, " ".join(["y z x"] * 20))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert ordered(decontam.verdicts(docs, benchmark).collect()) == ordered((i, *hits_by_hand(t, [(1, item)])) for i, t in texts)


def test_winnowing_leaves_a_common_fingerprint(spark):
    shared = " ".join(f"s{i}" for i in range(13))
    texts = [(i, " ".join(f"w{i}_{j}" for j in range(i)) + " " + shared + " " + " ".join(f"v{i}_{j}" for j in range(7 - i))) for i in range(7)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    prints = frame.select("doc_id", decontam.winnow(decontam.words_of(frame["text"])).alias("f")).selectExpr("doc_id", "transform(f, x -> x.h) as f").collect()
    assert all(set(a["f"]) & set(b["f"]) for a in prints for b in prints)


def fill(sizes, weights):
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = {s: 3 * sizes[s] for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            return capped | target
        capped |= over


def test_mixing(docs, no_docs, rows):
    found = mixing.taken_rows(docs).collect()
    sizes, size = defaultdict(int), [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    expected = sorted((repr(r[0]), n, sizes[r[3]], round(target[r[3]], 6)) for r, n in zip(rows, size, strict=True))
    assert sorted((repr(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in found) == expected
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    assert ordered(found) == ordered(mixing.taken_rows(docs).collect())
    assert mixing.taken_rows(no_docs).collect() == []


def test_mixing_comes_near_the_targets(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{min(i % 10, 4)}") for i in range(4000)]
    found = mixing.taken_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in found.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) < 0.1 * r["target"]


def test_mixing_emits_what_it_takes(docs):
    mixed = mixing.mix(docs)
    emitted = mixing.emit_copies(mixed, ["doc_id", "text"])
    assert emitted.count() == mixed.agg({"mix_copies": "sum"}).first()[0]


def sets_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_by_hand(rows):
    sets = [sets_by_hand(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)), r[0] == least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(docs, no_docs, rows):
    assert ordered(minhash.components(docs).collect()) == ordered(components_by_hand(rows))
    assert minhash.components(no_docs).collect() == []


def test_near_duplicates_in_chains_and_crowds(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], rng.choice(words, 120).tolist()
    for step in range(60):  # each text changes a little from the last, so ends of the chain differ
        rows.append((len(rows) * 7 % 997, " ".join(base)))
        base[int(rng.integers(0, 120))] = "n" + str(step)
    crowd = rng.choice(words, 200).tolist()
    for _ in range(60):
        own = list(crowd)
        for at in rng.integers(0, 200, int(rng.integers(0, 5))):
            own[at] = f"c{rng.integers(0, 10**6)}"
        rows.append((len(rows) * 7 % 997, " ".join(own)))
    passage = rng.choice(words, 40).tolist()
    rows += [(2000 + i, " ".join([*passage, *rng.choice(words, 25)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(minhash.components(docs).collect()) == ordered(components_by_hand(rows))


def near_copies(rng, base, n, edits, fresh):
    """Texts with the given numbers of words replaced by new ones."""
    for k in range(n):
        own = list(base)
        for at in rng.choice(len(own), int(rng.integers(*edits)), replace=False):
            own[at] = f"{fresh}{k}_{at}"
        yield " ".join(own)


def test_near_duplicates_of_a_crowd_with_stragglers(spark):
    """Stragglers are close to a large group, linked to none of it or to one straggler only."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base, other = rng.choice(words, 150).tolist(), rng.choice(words, 150).tolist()
    texts = [*near_copies(rng, base, 300, (1, 4), "a"), *near_copies(rng, base, 150, (4, 6), "b"), *near_copies(rng, base, 100, (6, 12), "c")]
    texts += [*near_copies(rng, base[:90] + other[:60], 60, (0, 5), "d"), *near_copies(rng, base[:75] + other[75:], 60, (2, 9), "e")]
    texts += [t.replace(" ", "  ") + " tail words here" for t in texts[460:520:3]]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(minhash.components(docs).collect()) == ordered(components_by_hand(rows))


def test_differences_link_what_sets_link(spark):
    """The links found by differences alone, all classes standing in one list."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 60).tolist()
    sets = {}
    for k in range(150):
        out = set(rng.choice(60, int(rng.integers(0, 14)), replace=False).tolist())
        sets[k] = sorted([x for i, x in enumerate(base) if i not in out] + rng.integers(0, 40, int(rng.integers(0, 8))).tolist())
    sets = {k: sorted(set(v)) for k, v in sets.items()}
    lists = spark.createDataFrame([(bytes([k]), bytes([k]), len(v), k, 0, 7) for k, v in sets.items()], "cls binary, comp binary, n long, reach long, j int, v int")
    found = minhash._by_differences(lists, spark.createDataFrame([(bytes([k]), v) for k, v in sets.items()], "cls binary, shingles array<long>")).df
    links = {frozenset((bytes(a)[0], bytes(b)[0])) for a, b in found.collect()}
    expected = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
    leader = {149}
    linked_to_leader = {a for a in sets if frozenset((a, 149)) in expected} | leader
    assert links <= expected and {p for p in expected if not p <= linked_to_leader} <= links


def test_sets_of_long_texts_in_parts(monkeypatch):
    import pyarrow as pa

    texts = [" ".join(f"Word{i % 977}" for i in range(5000)), "x" * 900 + " a b", " " * 1000, "a b c " + "\n" * 900 + "d", "one two three four five"]
    whole = [minhash.shingle_sets(pa.array([t]))[0].tolist() for t in texts]
    assert [s.tolist() for s in minhash.shingle_sets(pa.array(texts))] == whole
    monkeypatch.setattr(minhash, "PART_BYTES", 100)
    assert [minhash.shingle_sets(pa.array([t]))[0].tolist() for t in texts] == whole


def test_queries_match_their_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    for name, sql in oracle_sql().items():
        found = queries()[name](spark, sf_dir)
        cursor = connection.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(found.columns)
        assert ordered(found.select(*columns).collect()) == ordered(cursor.fetchall()), name


def test_plans_stay_in_the_engine(docs, spark, passage):
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    plan = decontam.verdicts(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
