import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loglake.llm import decontaminate, language, minhash, sampling, texts, tokens, toxicity
from loglake.session import delete_path, materialize


def test_words_are_split_as_bytes_do():
    held = ["a b  c\n", None, "", "  é x", "y", " \t\v\f\r", "z" * 9]
    words = texts.words_of(pa.array(held))
    found = [bytes(words.data[s:e]).decode() for s, e in zip(words.starts, words.ends)]
    split = [[w.decode() for w in (text or "").encode().split()] for text in held]
    assert found == sum(split, []) and words.counts.tolist() == list(map(len, split))
    same = texts.words_of(pa.array(["c y", "y a"]))
    assert same.hashes()[1] == same.hashes()[2] == words.hashes()[found.index("y")]
    assert texts.words_of(pa.array([], pa.string())).counts.tolist() == []


def test_words_have_one_hash_whatever_is_hashed_with_them(monkeypatch):
    rng = random.Random(3)
    held = [" ".join("abcé"[:rng.randrange(1, 5)] * rng.randrange(1, 30) for _ in range(40)) for _ in range(20)]
    words = texts.words_of(pa.array(held))
    whole = words.hashes()
    monkeypatch.setattr(texts, "_HASHED_BYTES", 50)
    texts._known_powers.clear()
    assert (words.hashes() == whole).all()
    one = texts.words_of(pa.array(["  " + held[3].split()[-1] + " "]))
    assert one.hashes()[0] == whole[words.bounds[4] - 1]


def test_hashing_takes_little_more_memory_than_its_result():
    words = texts.words_of(pa.array(["some words of a text "] * 100_000))
    tracemalloc.start()
    try:
        words.hashes()
        # 2.1 MB in 500,000 words: 4 MB of hashes, mixed in a few steps.
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_workers_return_memory_after_language_tasks(monkeypatch):
    calls = []
    monkeypatch.setattr(texts, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(language, "give_back", lambda: calls.append(1), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(["ein Text", None])], ["text"])
    assert list(language._partial_frequencies(iter([batch, batch]), 64))[0].to_pylist()[-1] == {"gram": -1, "n": 4}
    assert calls and not list(language._trainer(("de",), np.ones(64), 5)(iter([]))) and len(calls) == 2


def test_texts_reach_workers_a_few_megabytes_at_a_time(spark, monkeypatch):
    def small_only(batches, column, most=None):
        for batch in batches:
            longest = max(len(text or "") for text in batch.column(column).to_pylist())
            assert batch.nbytes - longest < 4 << 20, f"{batch.num_rows} rows of {batch.nbytes} bytes"
            yield batch

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    for module in (texts, decontaminate, language):
        monkeypatch.setattr(module, "pieces", small_only)
    monkeypatch.setattr(language, "slices", lambda batch, column: small_only([batch], column))
    # 18 MB in one task, and a text of 6 MB among them.
    body = F.when(F.col("id") == 40, F.repeat(F.lit("long text "), 600_000)).otherwise(
        F.repeat(F.concat(F.lit("a text of number "), F.col("id") % 30, F.lit(" ")), 5_000))
    docs = spark.range(0, 200, 1, 1).select(
        F.col("id").alias("doc_id"), body.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    benchmark = spark.createDataFrame([(1, "a benchmark item that no text has")], "item_id long, text string")
    model = language.LanguageModel(("en",), np.ones(64), np.zeros((64, 1), np.float32), np.zeros(1), 1.0)
    works = [
        lambda: decontaminate.drop_contaminated(docs, benchmark),
        lambda: decontaminate.contaminated(docs, benchmark),
        lambda: language.inverse_frequencies(docs, "text", 64),
        lambda: language.identify(docs, model),
        lambda: minhash.near_duplicate_classes(docs),
    ]
    counts = []
    for work in works:
        spark.conf.unset(limit)
        made = work()
        counts.append(len(made) if isinstance(made, np.ndarray) else made.count())
    assert counts == [200, 0, 64, 200, 200]
    # A session that names a limit keeps it.
    spark.conf.set(limit, "1m")
    language.identify(docs, model)
    assert spark.conf.get(limit) == "1m"
    spark.conf.unset(limit)


def test_scratch_files_are_cut_into_small_row_groups(spark):
    # Pages count as they are compressed, so the text must be one that does not shrink.
    digests = [F.sha2(F.concat(F.col("id").cast("string"), F.lit(f" {n}")), 256) for n in range(30)]
    docs = spark.range(0, 30_000, 1, 1).select("id", F.concat(*digests).alias("text"))
    stored, path = materialize(docs, "groups")
    (file,) = Path(path).glob("*.parquet")
    held = pq.ParquetFile(file).metadata
    # 58 MB, which a task had to hold as one group.
    assert max(held.row_group(at).total_byte_size for at in range(held.num_row_groups)) < 24 << 20
    assert stored.select(F.sum(F.xxhash64("id", "text").cast("decimal(38)"))).first() == docs.select(
        F.sum(F.xxhash64("id", "text").cast("decimal(38)"))).first()
    delete_path(spark, path)


def test_language_tasks_return_memory_once_all_texts_are_judged(monkeypatch):
    calls = []
    monkeypatch.setattr(texts, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(language, "give_back", lambda: calls.append(1))
    made = []
    monkeypatch.setattr(language.F, "arrow_udf", lambda kind: lambda run: lambda column: made.append(run))
    language.predicted(None, None)
    told = list(made[0](iter([pa.array(["a text"] * 3), pa.array([None, "b"])])))
    assert [len(part) for part in told] == [3, 2] and calls == [1]


def test_search_of_a_batch_takes_little_memory():
    rng = random.Random(5)
    held = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(1000)]
    item = decontaminate.normalised(held[-1][500:700])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(held)], ["doc_id", "text"])
    clean = decontaminate._cleaner([(1, item)], None, "text", 8, 0.08, 32)
    tracemalloc.start()
    try:
        assert [row for part in clean(iter([batch])) for row in part.column("doc_id").to_pylist()] == list(range(999))
        # 2 MB of text; its q-grams all at once took 55 MB.
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_pieces_hold_every_row(monkeypatch):
    monkeypatch.setattr(texts, "PIECE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 50, "", "abcdefgh", "ij"])], ["text"])
    parts = [p.column("text").to_pylist() for p in texts.pieces(iter([batch, batch.slice(0, 0)]), "text")]
    assert sum(parts, []) == batch.column("text").to_pylist() and max(map(len, parts)) < 6


def distance(item, text):
    """Edits between the item and the nearest part of the text."""
    before = [0] * (len(text) + 1)
    for row, char in enumerate(item, 1):
        now = [row]
        for at, other in enumerate(text, 1):
            now.append(min(before[at - 1] + (char != other), before[at] + 1, now[-1] + 1))
        before = now
    return min(before)


def damaged(text, edits, rng):
    held = list(text)
    for _ in range(edits):
        at = rng.randrange(len(held))
        held[at:at + rng.choice((0, 1, 1))] = rng.choice(("", "q", "z"))
    return " ".join("".join(held).split())


def test_leaks_against_brute_force(spark, documents, words):
    rng = random.Random(9)
    items = [(n, " ".join(words(rng.randrange(8, 26)))) for n in range(25)] + [(40, "tooshort"), (41, None), (42, "")]
    rows = []
    for n in range(120):
        body = " ".join(words(rng.randrange(60)))
        if n % 2:
            leak = damaged(items[n % 25][1], rng.randrange(0, 14), rng)
            body = [f"{leak} {body}", f"{body} {leak}", f"{body} {leak} {body}"][n % 3]
        rows.append((n, body if n % 5 else body.upper().replace(" ", ", ")))
    docs = documents([*rows, (500, None), (501, ""), (None, items[0][1])])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark, block_chars=900).collect()
    expected = {}
    for n, body in rows:
        plain = decontaminate.normalised(body)
        for key, item in items[:25] if n % 2 else ():
            budget = decontaminate.edit_budget(len(item))
            edits = distance(item, plain) if key == n % 25 else budget + 1
            if len(item) >= decontaminate.MIN_CHARS and edits <= budget:
                expected[n, key] = edits
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == expected and len(expected) > 20
    plain = {n: decontaminate.normalised(body) for n, body in rows}
    for r in got:
        part = plain[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert distance(dict(items)[r["item_id"]], part) <= r["edits"]
    kept = decontaminate.drop_contaminated(docs, benchmark)
    gone = {n for n, _ in expected}
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted([-1, 500, 501, *(n for n, _ in rows if n not in gone)])
    assert kept.columns == docs.columns


def test_leaks_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents([(1, "a b")]), none).count() == 0
    some = spark.createDataFrame([(1, "word " * 20)], "item_id long, text string")
    assert decontaminate.contaminated(documents([]), some).count() == 0
    assert decontaminate.contaminated(documents([(1, "word " * 3000), (1, "word " * 3000)]), some).count() == 2


SYLLABLES = {"aa": "ka ro ti mu se", "bb": "sch ung ein ber üß", "cc": "ción las que ñar os"}


def sentences(rng, lang, count):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(count))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    return [(n, sentences(rng, lang, rng.randint(4, 60)), lang) for n in range(300) for lang in [rng.choice("abc") * 2]]


def test_languages_of_held_out_texts(documents, labelled):
    model = language.train(documents(labelled[:200]))
    assert model.languages == ("aa", "bb", "cc") and (model.weights == 0).mean() > 0.5
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 ... !!", "aa"), (903, "é", None), (904, sentences(random.Random(2), "bb", 90_000), None)]
    docs = documents([*labelled[200:], *odd])
    told = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    right = [told[n][0] == lang for n, _, lang in labelled[200:]]
    assert np.mean(right) >= 0.98 and all(0 <= score <= 1 for _, score in told.values())
    assert [told[n][0] for n in (900, 901, 902, 904)] == ["und", "und", "und", "bb"]
    kept = language.reject_unknown(docs)
    assert kept.columns == docs.columns and kept.count() >= 98


def test_languages_without_labels(documents):
    docs = documents([(1, "abc", None, "s"), (2, "1", None, "s"), (3, None, None, "s")])
    assert language.train(docs) is None
    assert [r["lang_pred"] for r in language.identify(docs, None).collect()] == ["und"] * 3
    assert [r["doc_id"] for r in language.reject_unknown(docs).collect()] == [1]
    assert language.reject_unknown(documents([])).count() == 0


def test_grams_of_a_long_text_are_all_counted(monkeypatch):
    text = sentences(random.Random(3), "bb", 500)
    whole = dict(enumerate(next(language.gram_counts([text]))[1][0]))
    monkeypatch.setattr(language, "_PIECE_CHARS", 97)
    assert dict(enumerate(next(language.gram_counts([text]))[1][0])) == pytest.approx(whole, abs=12)
    assert sum(len(counts) for _, counts in language.gram_counts([None, "", "x" * 500, "y"])) == 4


def test_frequencies_cover_all_rows(spark, documents):
    docs = documents([(1, "ab"), (2, "ab"), (3, "zz"), (4, "")])
    idf = language.inverse_frequencies(docs, "text", 64)
    counts = np.concatenate([c for _, c in language.gram_counts(["ab", "ab", "zz", ""], 64)])
    assert idf == pytest.approx(np.log1p(5 / ((counts > 0).sum(axis=0) + 1)))


def bound_rows(monkeypatch, module):
    """Let the learning task fail if it reads or learns from more rows than it may."""
    trainer = module._trainer

    def watched(*given):
        def run(batches):
            held = list(batches)
            rows = sum(batch.num_rows for batch in held)
            groups = sum((batch.column("lang" if module is language else "toxic").to_pylist() for batch in held), [])
            folds, times = (sum((batch.column(c).to_pylist() for batch in held), []) for c in ("fold", "times"))
            assert rows <= 130 and len(sampling.cut(groups, folds, times, given[-1])) == 2 * given[-1]
            yield from trainer(*given)(iter(held))
        return run

    monkeypatch.setattr(module, "_trainer", watched)


def test_samples_are_bounded_by_rows(spark, documents, monkeypatch):
    rng = random.Random(12)
    rows = [(None, sentences(rng, lang, 12), lang) for lang in ("aa", "bb") * 400] + [(None, "ka ro ti", "aa")] * 400
    bound_rows(monkeypatch, language)
    assert language.train(documents(rows), rows_per_language=20).languages == ("aa", "bb")
    held = [(5 + n % 2, f"{text} {'grobian halunke' if n % 2 else ''}") for n, (_, text, _) in enumerate(rows)]
    bound_rows(monkeypatch, toxicity)
    labels = spark.createDataFrame([(5, 0), (6, 1), (7, 1)], "doc_id long, toxic int")
    toxicity.train(documents(held), labels, rows_per_label=20)


def test_cut_counts_repeated_rows():
    places = sampling.cut([0, 1, 0, 0], [9, 1, 2, 5], [4, 1, 1, 2], 5)
    assert places.tolist() == [1, 2, 3, 3, 0, 0]


def toxic_rows(rng, count):
    rows, labels = [], []
    for n in range(count):
        held = sentences(rng, rng.choice(("aa", "bb")), rng.randint(10, 120)).split()
        bad = n % 4 == 0
        for _ in range(rng.randint(2, 5) if bad else 0):
            held.insert(rng.randrange(len(held)), rng.choice(("grobian", "halunke", "taugenichts")))
        rows.append((n, " ".join(held)))
        labels.append((n, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_texts(spark, documents):
    rows, labels = toxic_rows(random.Random(4), 900)
    told = spark.createDataFrame([*labels[:600], (None, 1), (601, None), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(documents(rows), told)
    docs = documents([*rows, (990, None), (991, ""), (992, "!!")])
    score = {r["doc_id"]: r["score"] for r in docs.select(
        "doc_id", toxicity.toxicity(F.col("text"), model).alias("score")).collect()}
    bad = [score[n] >= toxicity.THRESHOLD for n, label in labels[600:] if label]
    good = [score[n] >= toxicity.THRESHOLD for n, label in labels[600:] if not label]
    assert np.mean(bad) > 0.9 and np.mean(good) < 0.05
    assert all(0 <= s <= 1 for s in score.values()) and max(score[n] for n in (990, 991, 992)) < 0.5


def test_toxicity_without_examples(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents([(1, "abc"), (2, None)])
    assert toxicity.train(docs, none) is None
    assert toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")) is None
    assert [r[0] for r in docs.select(toxicity.toxicity(F.col("text"), None)).collect()] == [0.0, 0.0]


def test_token_table_against_brute_force(spark, documents, words):
    held = [" ".join(words(n % 17)) for n in range(60)] + [None, "", "<|endoftext|>", "Zürich\n\n 12"]
    encode = tokens.encoder().encode_ordinary
    lengths = [len(encode(text or "")) for text in held]
    table = tokens.context_table(tokens.length_histogram(documents(list(enumerate(held)))))
    rows = table.collect()
    assert sorted(r["length"] for r in rows) == sorted(set(lengths))
    for r in rows:
        limit = r["length"]
        assert r["n_docs"] == lengths.count(limit) and r["n_tokens"] == limit * lengths.count(limit)
        assert r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["tokens_truncated"] == sum(min(n, limit) for n in lengths)
        assert r["tokens_within"] == sum(n for n in lengths if n <= limit)
    limits = {r["context"]: (r["tokens_truncated"], r["docs_longer"]) for r in tokens.truncated_totals(table, [0, 7, 10_000]).collect()}
    assert limits == {c: (sum(min(n, c) for n in lengths), sum(n > c for n in lengths)) for c in (0, 7, 10_000)}
    assert tokens.quantile(table, 0.5) == sorted(lengths)[len(lengths) // 2 - 1]
    empty = tokens.context_table(tokens.length_histogram(documents([])))
    assert empty.count() == 0 and tokens.quantile(empty, 0.5) is None


def test_leaks_of_rows_without_keys_in_many_blocks(spark):
    items = [(n if n % 3 else None, " ".join(f"w{n}x{k * k}" for k in range(12 + n))) for n in range(9)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    docs = spark.createDataFrame(
        [(None, f"before {items[n][1]} behind", {"a": n}, n) for n in range(9)]
        + [(None, None, None, -1), (7, "", {}, -2), (None, "clean text of no item at all", {"b": 1}, -3)],
        "doc_id long, text string, _found map<string, int>, item_id int")
    got = decontaminate.contaminated(docs, benchmark, block_chars=150, keyless=True).collect()
    assert sorted(repr(r["item_id"]) for r in got) == sorted(repr(item) for item, _ in items)
    assert all(r["doc_id"] is None and r["edits"] == 0 for r in got)
    for size in (150, 10 ** 6):
        kept = decontaminate.drop_contaminated(docs, benchmark, block_chars=size, keyless=True)
        assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [-3, -2, -1]


def test_short_items_occur_as_whole_words(spark, documents):
    items = [(1, "Too short!"), (2, "too  short"), (3, None), (4, "?!"), (5, "a b"), (None, "way too"), (6, "\u00e9t\u00e9"),
             (7, "an item that is long enough to be aligned")]
    rows = [(1, "Way TOO -- short; too short"), (2, "too shorter"), (3, "a b a b a"), (4, "ab"), (5, None), (6, ""),
            (7, "un \u00c9T\u00c9 chaud"), (8, "x " * 200_000 + "too short"), (9, "too"), (9, "too short"), (9, "too short")]
    docs, benchmark = documents(rows), spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for n, body in rows:
        plain = f" {decontaminate.normalised(body)} "
        for key, item in items[:-1]:
            short = decontaminate.normalised(item)
            if short and key is not None and f" {short} " in plain:
                expected.append((n, key, plain.index(f" {short} "), len(short), 0))
    got = decontaminate.contaminated(docs, benchmark, block_chars=20).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) == 10
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 9]
    keyless = decontaminate.contaminated(docs, benchmark, keyless=True).filter("item_id IS NULL").collect()
    assert [(r["doc_id"], r["start"]) for r in keyless] == [(1, 0)]
