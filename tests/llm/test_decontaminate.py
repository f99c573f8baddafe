import re

from tidewater.llm.common import read
from tidewater.llm.decontaminate import contamination, op8_decontaminate, without_benchmark

SF = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id long, text string, hash string, __doc int", "item_id long, text string"
QUESTION = "A train leaves the station at 9 and travels 120 km in 2 hours before the driver Anna stops, how fast did it go on that long way north?"


def run(spark, docs, items):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    return {(r["doc_id"], r["item_id"]) for r in contamination(df, spark.createDataFrame(items, ITEMS)).collect()}


def test_query_finds_every_item_that_a_document_holds(spark):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: " ".join(words(r["text"])) for r in read(spark, SF, "benchmark").collect()}
    texts = {r["doc_id"]: f" {' '.join(words(r['text']))} " for r in read(spark, SF, "documents").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op8_decontaminate(spark, SF).collect()}
    assert got == {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in t} and got


def test_other_numbers_names_and_units_are_found_if_slots_agree(spark):
    other = QUESTION.replace("9", "7").replace("120 km", "300 miles").replace("2 hours", "5 days").replace("Anna", "Peter")
    noise = "some words before it that mean nothing at all and go on "
    docs = [(1, noise + other + " " + noise), (2, QUESTION), (3, noise * 5), (4, QUESTION[:40]), (5, None), (6, ""), (7, QUESTION.upper().replace(",", ";"))]
    got = run(spark, docs, [(1, QUESTION), (2, "an unrelated question about the boiling point of water at sea level")])
    assert {(1, 1), (2, 1)} <= got and not {d for d, _ in got} & {3, 4, 5, 6}


def test_inconsistent_slots_are_not_found(spark):
    item = "If you take 5 apples and give 5 apples away then add 5 pears to the same small basket what is left in it"
    same = item.replace("5", "8")
    mixed = item.replace("5", "8", 1).replace("5", "3", 1)
    assert run(spark, [(1, same), (2, mixed)], [(1, item)]) == {(1, 1)}
    # Two values of the item may not meet one of the document either.
    two = "Take 4 pears and 9 plums from the shelf and then put 4 pears and 9 plums into the old wooden bowl again"
    assert run(spark, [(1, two.replace("9", "6")), (2, two.replace("9", "4"))], [(1, two)]) == {(1, 1)}


def test_items_are_found_in_any_case(spark):
    words = "what do the old ships carry across the cold northern sea in the first days of winter".split()
    items = [(1, " ".join(words)), (2, " ".join(w.title() for w in reversed(words))), (3, QUESTION.upper()), (4, "Who Wrote The Long Book About Rivers In Peru")]
    docs = [(10 * i + j, f"so it begins. {f(t)} and so it ends.") for i, t in items for j, f in enumerate((str, str.lower, str.upper, str.title))]
    assert run(spark, docs, items) == {(d, d // 10) for d, _ in docs}


def test_edges(spark):
    items = [(1, "one two"), (2, "one two"), (3, None), (4, "")]
    assert run(spark, [(1, "zero one two three"), (2, "one three two"), (None, "one two"), (1, "zero one two three")], items) == {(1, 1), (1, 2), (None, 1), (None, 2)}
    assert run(spark, [(1, "a b")], []) == set() and run(spark, [], items) == set()
    df = spark.createDataFrame([(1, "zero one two", "x", 1), (2, "other", "x", 1), (None, "one two", "x", 1)], DOCS)
    kept = without_benchmark(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [2]
    long = "filler words " * 50_000 + QUESTION
    assert run(spark, [(1, long)], [(1, QUESTION)]) == {(1, 1)}


ITEM = "a baker fills twelve trays with bread and sells most of them before noon so how many loaves are still left in the shop this evening"


def test_edited_words_and_long_parts_are_found(spark):
    words = ITEM.split()
    noise = "nothing of this kind is asked here "
    docs = [(1, noise + ITEM.replace("sells", "gives") + " " + noise), (2, noise + " ".join(words[:15]) + " " + noise), (3, noise + " ".join(words[:8]) + " " + noise), (4, ITEM.replace("bread", "cake").replace("still", "then"))]
    assert run(spark, docs, [(1, ITEM)]) == {(1, 1), (2, 1), (4, 1)}


def test_items_without_usable_windows_are_found_as_they_stand(spark):
    items = [(1, "12 + 7 - 3 = 16"), (2, "42"), (3, "+ - =")]
    docs = [(1, "so 12 + 7\n- 3 = 16 holds"), (2, "12, 7, 3, 16"), (3, "112 + 7 - 3 = 165"), (4, "42"), (5, "it is 42"), (None, "12 + 7 - 3 = 16"), (6, "+ - =")]
    assert run(spark, docs, items) == {(1, 1), (None, 1), (4, 2)}


def test_names_that_begin_sentences_or_have_two_words_are_exchanged(spark):
    item = "Weng has 12 apples in a basket. Weng gives 3 apples to a friend. Weng then buys 5 more apples at the market in Oslo. How many are there now?"
    other = item.replace("Weng", "Anna").replace("Oslo", "New York").replace("12", "15")
    assert run(spark, [(1, "some words before it. " + other), (3, item)], [(1, item)]) == {(1, 1), (3, 1)}


def test_copies_in_another_case_or_context_are_found(spark):
    items = [(1, "Peter and Anna met Paul and Maria near the Tower of London after Carl left Berlin for Rome."), (2, "What is photosynthesis?")]
    docs = [(1, items[0][1].lower()), (2, "The teacher asked us: what is photosynthesis? Nobody knew"), (3, "It is asked, What is photosynthesis?"), (4, "what is it")]
    assert run(spark, docs, items) == {(1, 1), (2, 2), (3, 2)}


def test_runs_of_names_and_numbers_of_any_length(spark):
    docs = [(1, "Thouingerinoran " * 50_000 + "so it goes. " + QUESTION), (2, "1,2:3/" * 50_000 + "4 so it goes. " + QUESTION), (3, "Orre " * 50_000), (4, "7.5," * 50_000 + "1")]
    assert run(spark, docs, [(1, QUESTION)]) == {(1, 1), (2, 1)}


def test_only_native_operators(spark):
    from tidewater.llm.decontaminate import CASELESS, NAMES, windows

    df = spark.createDataFrame([(1, QUESTION, "x", 1)], DOCS)
    for kind in (NAMES, CASELESS):
        plan = windows(df.select("doc_id", "text"), "doc_id", [5], kind)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|ArrowEval", plan)
