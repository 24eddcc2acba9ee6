import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loglake.llm import lines, mixing, shards


def test_hilbert_index_visits_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3)):
        cells = spark.range(1 << (dims * bits)).select(
            *(F.shiftright("id", axis * bits).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"c{axis}") for axis in range(dims)))
        rows = cells.select("*", shards.hilbert_index([F.col(f"c{a}") for a in range(dims)], bits).alias("i")).collect()
        order = sorted(rows, key=lambda r: r["i"])
        assert [r["i"] for r in order] == list(range(1 << (dims * bits)))
        assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(order, order[1:]))


def shard_rows(documents, rows, count=4):
    return shards.assign_shards(documents(rows), count).select("doc_id", "text", "shard", "slot", "curve", "row").collect()


@pytest.mark.parametrize("size", [0, 1, 3, 4, 50, 51])
def test_shards_are_even_runs_of_the_curve(documents, size):
    rows = [(n if n % 9 else None, ["", None, "a", "b" * 300][n % 4], "en", f"s{n % 3}") for n in range(size)]
    got = shard_rows(documents, rows)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    members = defaultdict(list)
    for r in got:
        members[r["shard"]].append(r)
    counts = [len(members[s]) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in held) == list(range(len(held))) for held in members.values())
    ends = [(min(r["curve"] for r in members[s]), max(r["curve"] for r in members[s])) for s in range(4) if members[s]]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_equal_rows_are_all_placed(documents):
    got = shard_rows(documents, [(7, "same")] * 41)
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted(
        [(0, n) for n in range(11)] + [(s, n) for s in (1, 2, 3) for n in range(10)])


def test_written_shards_come_back(documents, spark, tmp_path):
    placed = shards.assign_shards(documents([(n, "t" * n) for n in range(30)]), 3)
    shards.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 3


def starts_by_hand(values, levels):
    counts = sorted(Counter(value[:shards.PREFIX] for value in values if value is not None).items())
    if len(counts) <= levels:
        return [value for value, _ in counts]
    first, before, total = {}, 0, sum(n for _, n in counts)
    for value, n in counts:
        first.setdefault(before * levels // total, value)
        before += n
    return sorted(first.values())


@pytest.mark.parametrize("values", [
    [], [None, None], ["b", "a", None, "b", ""], [f"s{n}" for n in range(7)], [f"s{n * n % 97}" for n in range(400)],
    ["hot"] * 200 + [f"\u00e9{n}" for n in range(100)] + [None], ["x" * 70 + str(n) for n in range(50)]])
def test_categories_fill_levels_in_order(spark, values):
    docs = spark.createDataFrame([(v,) for v in values], "source string").repartition(5)
    starts = shards.category_starts(docs, F.col("source"), bits=3)
    assert starts == starts_by_hand(values, 7) and len(starts) <= 7
    for r in docs.select("source", shards.category_level(F.col("source"), starts).alias("level")).collect():
        assert r["level"] == (0 if r["source"] is None else sum(s <= r["source"][:shards.PREFIX] for s in starts))


def test_readers_skip_files_by_statistics(documents, spark, tmp_path):
    rows = [(n, "t" * (n * 37 % 4000), ("de", "en", "en", "fr")[n % 4], f"src{n * 7 % 20}") for n in range(4000)]
    shards.write_shards(shards.assign_shards(documents(rows), 24), str(tmp_path / "shards"))
    ranges = spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").agg(
        F.min("source").alias("low"), F.max("source").alias("high"), F.collect_set("source").alias("held")).collect()
    names = {row[3] for row in rows}
    opened = sum(r["low"] <= name <= r["high"] for r in ranges for name in names) / len(names)
    holding = sum(name in r["held"] for r in ranges for name in names) / len(names)
    assert opened <= 1.5 * holding and opened < 8


def test_sizes_and_checksums(documents):
    text = F.col("text")
    rows = documents([(1, "é"), (2, None), (3, "")]).select(
        "doc_id", shards.text_size(text).alias("size"), F.crc32(text).alias("crc")).collect()
    assert {r["doc_id"]: (r["size"], r["crc"]) for r in rows} == {
        1: (10, zlib.crc32("é".encode())), 2: (8, None), 3: (8, 0)}


def mixed(docs, **options):
    return mixing.mix(docs, **options).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()


def test_mix_fills_targets_and_repeats(documents, words):
    rows = [(n, " ".join(words(1 + n % 40)), "en", ("a", "b", None, "c")[n % 4] if n % 3 else "a") for n in range(600)]
    got = mixed(documents(rows))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixed(documents(rows, 7))), key=repr)
    taken, facts = defaultdict(int), {}
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["size"] == 1 + r["doc_id"] % 40
        taken[r["source"]] += r["size"] * r["copies"]
        facts[r["source"]] = (r["source_size"], r["target"])
    total = sum(size for size, _ in facts.values())
    assert sum(target for _, target in facts.values()) == pytest.approx(1.5 * total)
    assert all(target <= 2 * size and abs(taken[s] - target) <= 20 for s, (size, target) in facts.items())


def test_mix_of_nothing(documents):
    assert mixed(documents([])) == []
    got = mixed(documents([(1, None), (2, ""), (None, " \t"), (2, "")]))
    assert len(got) == 4 and all((r["size"], r["copies"]) == (0, 0) for r in got)
    assert mixing.expand_copies(mixing.mix(documents([(1, None)]))).count() == 0


def test_weight_prefers_documents(documents):
    rows = [(n, "a b c d", "en", ("a", "b")[n % 2]) for n in range(400)]
    got = mixed(documents(rows), share=0.5, weight=F.when(F.col("doc_id") < 200, 3.0).otherwise(1.0))
    early = sum(r["copies"] for r in got if r["doc_id"] < 200)
    assert early > 1.8 * sum(r["copies"] for r in got if r["doc_id"] >= 200) > 0


@pytest.mark.parametrize("key", [None, 7])
@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows_fill_a_target_to_the_row(documents, key, parts):
    rows = [(key, "a b c d e f g h i j", "en", ("s", None)[n % 3 == 0]) for n in range(900)]
    for r in mixed(documents(rows, parts)):
        assert r["copies"] in (1, 2)
    taken = defaultdict(int)
    facts = {}
    for r in mixed(documents(rows, parts), share=0.75):
        taken[r["source"]] += r["size"] * r["copies"]
        facts[r["source"]] = r["target"]
    assert all(abs(taken[s] - target) <= 5 for s, target in facts.items()) and len(facts) == 2


def test_texts_of_one_key_have_draws_of_their_own(documents, words):
    rows = [(5, " ".join(words(10)) + f" {n}", "en", "s") for n in range(400)]
    got = mixed(documents(rows), share=0.5)
    assert abs(sum(r["size"] * r["copies"] for r in got) - got[0]["target"]) <= 6


@pytest.mark.parametrize("share", [0.3, 0.9, 1.5, 1.9, 2.0])
def test_targets_are_met_whatever_the_weights(documents, share):
    rows = [(n, "a " * (1 + n % 50), "en", "s") for n in range(700)]
    odd = F.when(F.col("doc_id") % 4 == 0, 40.0).when(F.col("doc_id") % 4 == 1, -3.0).when(F.col("doc_id") % 4 == 2, 0.1)
    got = mixed(documents(rows), share=share, weight=odd)
    assert abs(sum(r["size"] * r["copies"] for r in got) - got[0]["target"]) <= 25
    assert all(0 <= r["copies"] <= 2 for r in got)
    heavy = [r["copies"] for r in got if r["doc_id"] % 4 == 0]
    assert sum(heavy) / len(heavy) >= min(2, 3 * share) * 0.85


def test_length_preference(spark):
    sizes = spark.createDataFrame([(0,), (63,), (64,), (511,), (512,)], "n long")
    assert [r[0] for r in sizes.select(mixing.length_preference(F.col("n"))).collect()] == [0.5, 0.5, 1.0, 1.0, 2.0]


def test_expanded_copies_are_whole_rows(documents):
    docs = documents([(n, "one two", "en", "s") for n in range(20)])
    assert mixing.expand_copies(mixing.mix(docs)).columns == docs.columns
    assert mixing.expand_copies(mixing.mix(docs)).count() == 30


def brute_lines(texts):
    first, out = {}, {}
    for key, text in sorted(texts.items()):
        held = text.split("\n")
        for at in range(len(held) - 2):
            first.setdefault(tuple(held[at:at + 3]), (key, at))
    for key, text in texts.items():
        held, gone = text.split("\n"), set()
        for at in range(len(held) - 2):
            window = tuple(held[at:at + 3])
            if first[window] != (key, at) and "".join(window).strip(" "):
                gone |= {at, at + 1, at + 2}
        out[key] = ("\n".join(line for at, line in enumerate(held) if at not in gone), len(held), len(gone))
    return out


def test_lines_against_brute_force(documents, words):
    pool = [" ".join(words(3)) for _ in range(12)] + ["", " "]
    texts = {n: "\n".join(pool[(n * 7 + k * (1 + n % 3)) % len(pool)] for k in range(n % 30)) for n in range(90)}
    texts[200] = "\n".join(["again"] * 2000)
    got = lines.dedup_lines(documents(list(texts.items()))).collect()
    assert {r["id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == brute_lines(texts)


def test_lines_of_odd_rows(documents):
    rows = [(1, None), (2, ""), (None, "a\nb\nc"), (3, "a\nb\nc"), (4, "x\ny\nz"), (4, "x\ny\nz"), (5, "a\nb")]
    got = lines.dedup_lines(documents(rows)).select("id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, None, 0, 0), (2, "", 1, 0), (None, "a\nb\nc", 3, 0), (3, "", 3, 3), (4, "x\ny\nz", 3, 0),
         (4, "x\ny\nz", 3, 0), (5, "a\nb", 2, 0)], key=repr)
    assert lines.dedup_lines(documents([])).count() == 0
