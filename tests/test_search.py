import datetime as dt
import random

import pytest

import loglake as L
from loglake.operators.aggregate import aggregate_logs
from loglake.operators.search import BITS, file_bits, files_without, literal_parts, needed_spots
from loglake.plans.specs import LogFilter

WIDE = {"since": "2020-01-01T00:00:00Z", "until": "2030-01-01T00:00:00Z", "bucket": "1d"}


def leaves(node):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return leaves(node.executedPlan())
    if "QueryStage" in name:
        return leaves(node.plan())
    children = node.children()
    return sum((leaves(children.apply(at)) for at in range(children.size())), []) or [node]


def files_read(df):
    """Files that the scan opened, by Spark's own count."""
    df.collect()
    found = [leaf.metrics() for leaf in leaves(df._jdf.queryExecution().executedPlan())]
    return sum(metrics.apply("numFiles").value() for metrics in found if metrics.contains("numFiles"))


@pytest.fixture(scope="module")
def indexed(spark, make_logs, tmp_path_factory):
    rng = random.Random(1)
    table = L.LogTable(spark, str(tmp_path_factory.mktemp("search") / "table"))
    rows = [(n, f"2024-03-{1 + n % 20:02d}T10:00:00Z", {
        "message": f"request {rng.randrange(10 ** 6)} Ärger üx\U0001f600 {'needle' if n % 20 == 7 and n < 100 else 'hay'} 50%_done",
        "attributes": {"host": f"h{n % 20}", "n": str(n), "e": ""}}) for n in range(400)]
    table.append(make_logs(rows, 3))
    table.index_search()
    # A day that no index knows.
    table.append(make_logs([(900, "2024-04-01T00:00:00Z", {"message": "unseen NEEDLE", "attributes": {"host": "h3"}})]))
    return table


SEARCHES = [
    {"q": "needle"}, {"q": "NEEDLE"}, {"q": "ne"}, {"q": "nee%le"}, {"q": "n_edle"}, {"q": "ärger"}, {"q": "üx\U0001f600 "},
    {"q": "50\\%\\_done"}, {"q": "50%_done", "search_mode": "substring"}, {"q": "nowhere to be found"}, {"q": ""},
    {"attributes": (("host", "h3"),)}, {"attributes": (("n", "17"),)}, {"attributes": (("e", ""),)},
    {"attributes": (("none", "x"),)}, {"attributes": (("host", "h7"),), "q": "needle"}]


@pytest.mark.parametrize("search", SEARCHES, ids=str)
def test_results_are_those_of_reading_everything(indexed, search):
    query = L.AggregateQuery(**{**{k: v for k, v in WIDE.items()}, **search})
    assert indexed.aggregate(query).collect() == aggregate_logs(indexed.scan(), query).collect()
    page = L.LogsQuery(limit=1000, **search)
    assert indexed.page(page).logs == L.fetch_page(indexed.scan(), page).logs


def test_rare_terms_and_attributes_read_few_files(indexed):
    def read(**search):
        return files_read(indexed.aggregate(L.AggregateQuery(**{**WIDE, **search})))

    everything = len(indexed.scan().inputFiles())
    assert everything == 21 and read(q="hay") == 20 + 1
    # The day of the needles and the one without bits.
    assert read(q="needle") == 2 and read(attributes=(("host", "h7"),)) == 2
    assert read(q="ne") == everything
    indexed.index_search()
    assert read(attributes=(("n", "17"),)) == 1 and read(q="nowhere to be found") == 0


def test_literal_parts():
    assert literal_parts("%a\\%b_c%d\\\\%") == ["a%b", "c", "d\\"]
    assert literal_parts("%\\%") == ["%"] and literal_parts("%%") == []


def test_needed_spots(spark):
    assert needed_spots(spark, LogFilter(q="ab")) == needed_spots(spark, LogFilter()) == []
    assert needed_spots(spark, LogFilter(q="ABC")) == needed_spots(spark, LogFilter(q="abc")) != []
    assert len(needed_spots(spark, LogFilter(q="abcd", attributes=(("k", "v"),)))) == 3
    assert len(needed_spots(spark, LogFilter(q="".join(map(chr, range(97, 500)))))) == 64


def test_retention_and_truncation_take_bits_along(spark, make_logs, table):
    table.append(make_logs([(n, f"2024-03-{n:02d}T00:00:00Z") for n in range(1, 10)]))
    table.index_search()
    table.retain(dt.datetime(2024, 3, 20, tzinfo=dt.timezone.utc), L.RetentionOptions(days=15), bounded=False)
    assert table._days(table.search_path) == table._days(table.logs_path)
    query = L.AggregateQuery(**{**WIDE, "q": "message 7"})
    assert [row["count"] for row in table.aggregate(query).collect()] == [1]


def test_bits_are_joined_by_hash_and_bounded_by_their_number(spark, make_logs, table):
    table.append(make_logs([(n, "2024-03-01T00:00:00Z", {
        "message": "the same words in every record", "attributes": {"k": "v"}}) for n in range(500)], 1))
    bits = file_bits(table.scan())
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    # One row for each word of 64 bits, and one that marks the file.
    spots = set(needed_spots(spark, LogFilter(q="the same words in every record", attributes=(("k", "v"),))))
    rows = {row["word"]: row["held"] % 2 ** 64 for row in bits.collect()}
    wanted = {word: sum(1 << place for at, place in spots if at == word) for word, _ in spots}
    assert rows == {**wanted, -1: 1}


def test_the_highest_bit_of_a_word_is_found(spark):
    bits = spark.createDataFrame([("f", -1, 1, None), ("f", 5, -2 ** 63, None), ("g", -1, 1, None), ("g", 5, 2 ** 62, None)], BITS)
    assert files_without(bits, [(5, 63)]) == ["g"] and files_without(bits, [(5, 62)]) == ["f"]
    assert sorted(files_without(bits, [(6, 0)])) == ["f", "g"]
