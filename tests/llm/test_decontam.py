import random
import re

import numpy as np
import pyarrow as pa

from ionloom.llm import decontam
from ionloom.llm.decontam import UNITS, contaminated, contamination, template_classes

QUESTION = "Anna has 12 apples and gives 5 apples to Berta while walking 3 km along the old river road. How many apples does Anna keep?"
OTHER_VALUES = QUESTION.replace("Anna", "Carla").replace("Berta", "Dora").replace("12", "40").replace("5 apples", "8 apples").replace("3 km", "7 km")
INCONSISTENT = OTHER_VALUES.replace("does Carla keep", "does Dora keep")


def filler(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def found(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, hash string, item_id string").repartition(2)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in contamination(docs, bench, **more).collect()}


def test_verbatim_reparameterised_and_clean(spark):
    texts = [f"{filler(1)} {QUESTION} {filler(2)}", f"{filler(3)} {OTHER_VALUES} {filler(4)}", filler(5, 300), QUESTION.upper(), f"{filler(6)} Anna has 12 apples and gives {filler(7)}"]
    out = found(spark, texts, [QUESTION, filler(8, 30)])
    assert set(out) == {(0, 0), (1, 0), (3, 0)}
    assert out[0, 0]["verbatim"] and not out[1, 0]["verbatim"] and out[0, 0]["share"] == 1.0


def test_slots_must_map_one_to_one(spark):
    item = "Anna met Berta near the very old stone bridge and then Anna asked Berta about the big red boat today"
    swapped = "Carla met Dora near the very old stone bridge and then Dora asked Emil about the big red boat today"
    same = "Carla met Dora near the very old stone bridge and then Carla asked Dora about the big red boat today"
    out = found(spark, [same, swapped], [item])
    assert set(out) == {(0, 0)}


def test_short_items_punctuation_and_odd_rows(spark, odd_docs, no_docs):
    out = found(spark, ["We say: where is, the lost key? now", None, "", "the lost", filler(9, 50_000) + " where is the lost key"], ["Where is the lost key", "too short", None, ""])
    assert set(out) == {(0, 0), (4, 0)}
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in contamination(odd_docs, bench).collect()}
    assert hits == {(1, 1), (1, 2), (None, 1), (None, 2)}
    assert contamination(no_docs, bench).count() == 0
    assert contamination(odd_docs, bench.where("item_id < 0")).count() == 0


def test_a_contradicting_slot_costs_its_windows_only(spark):
    merged = OTHER_VALUES.replace("40 apples", "8 apples")  # 12 and 5 become equal
    item = "The first shelf holds 5 red books while the second shelf in the long hall holds 5 green books and some old maps"
    parted = item.replace("5 red", "3 red").replace("5 green", "7 green")
    long_item = " ".join(f"{filler(20 + i, 12)} 5 {filler(40 + i, 3)}" for i in range(8))
    one_changed = long_item[::-1].replace("5", "9", 1)[::-1]
    out = found(spark, [merged, parted, one_changed], [QUESTION, item, long_item])
    assert set(out) == {(0, 0), (1, 1), (2, 2)}
    assert 0.8 < out[2, 2]["share"] <= 1.0


def test_slots_of_several_words_and_changes_in_short_items(spark):
    items = [
        "how much does it cost to buy 3.5 litres of fresh milk at the corner shop",
        "how many people moved from New York to the coast after the great flood in spring",
        "a rent of $1,200 is due on the first day of each month for the old house",
        "where did the tall grey heron build its nest last year",
        "who ate the last piece of cake",
    ]
    texts = [
        items[0].replace("3.5", "4"),
        items[1].replace("New York", "Boston"),
        items[2].replace("$1,200", "$900"),
        items[3].replace("grey heron", "grey old heron"),
        items[3].replace("grey", "white"),
        f"where did the {filler(10, 40)} build its nest {filler(11, 40)} last year",
        "who ate the last piece of pie",
    ]
    assert set(found(spark, [f"{filler(12)} {t} {filler(13)}" for t in texts], items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}


def test_a_capital_word_before_the_item_is_no_conflict(spark):
    out = found(spark, [f"{filler(14)} Question {OTHER_VALUES}"], [QUESTION])
    assert out[0, 0]["share"] == 1.0 and not out[0, 0]["verbatim"]


def test_items_of_numbers_and_of_scripts_without_spaces(spark):
    series = "3 8 15 24 35 48 63 80 99 120 next"
    dates = "1914-07-28, 1939-09-01 and 1945-05-08"
    chinese = "小明有十二个苹果，他给了小红五个苹果，请问还剩几个？"
    thai = "แมวของฉันชอบนอนบนเก้าอี้ตัวเก่า"
    texts = [f"{filler(15)} {series} {filler(16)}", f"{filler(17)} {dates}", f"今天的作业：{chinese}谢谢", f"ก{thai}ข", "小红喜欢在公园里跑步。", "3 9 15 25 35 49 63 81 99 121 next"]
    out = found(spark, texts, [series, dates, chinese, thai, "中国"])
    assert set(out) == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert all(r["verbatim"] and r["share"] == 1.0 for r in out.values())


def test_one_template_many_items_gives_a_row_per_document(spark):
    words = "adds {} red stones to the heavy box and then carries {} of them over the old bridge before sunset"
    items = [f"Anna{i} " + words.format(i + 10, 500 + i) for i in range(60)]
    texts = [f"{filler(100 + i, 20)} Berta " + words.format(2000 + i, 4000 + i) + f" {filler(300 + i, 20)}" for i in range(40)]
    texts += [filler(7), items[33].upper(), items[41]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, class long")
    bench = spark.createDataFrame([(i + 5, t) for i, t in enumerate(items)] + [(5, items[0]), (None, items[1])], "item_id long, text string")
    out = contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["items"]) for r in out) == [(i, 5, 61) for i in range(43) if i != 40]
    assert {r["doc_id"] for r in out if r["verbatim"]} == {41, 42}
    named = {tuple(r) for r in template_classes(bench).collect()}
    assert named == {(i, 5) for i in [*range(5, 65), None]}
    assert contamination(docs, bench).count() == 42 * 61


def test_words_with_a_digit_inside_are_words(spark):
    item = "the study of covid19 in the town of a4 readers shows that topic7 is the one most people like"
    other = item.replace("covid19", "covid20").replace("a4", "b5").replace("topic7", "topic8")
    assert set(found(spark, [item, other], [item])) == {(0, 0)}


def test_poor_items_share_no_class(spark):
    series = [" ".join(["next", *map(str, range(k, 60 * k, k))]) for k in (3, 7)]
    bench = spark.createDataFrame(list(enumerate([*series, series[0]])), "item_id long, text string")
    assert {tuple(r) for r in template_classes(bench).collect()} == {(0, 0), (1, 1), (2, 0)}


def test_against_all_pairs(spark):
    """All documents by all items: whole items are found, and what is found holds half of an item by the loosest template."""
    folder = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")

    def tokens(text, loose):
        kept = re.findall(r"[^\s!-/:-@\[-`{-~]+", text or "")
        return [("#" if w[0].isdigit() or w[0].isupper() or w.lower() in UNITS else w) if loose else w.lower() for w in kept]

    def grams(ws, n):
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    def collapsed(ws):
        return [w for i, w in enumerate(ws) if w != "#" or i == 0 or ws[i - 1] != "#"]

    texts = [(r["doc_id"], " ".join(tokens(r["text"], False)), {k for n in (3, 4, 6, 8) for ws in (collapsed(tokens(r["text"], True)), tokens(r["text"], False)) for k in grams(ws, n)}) for r in docs.collect()]
    whole, possible = set(), set()
    for r in bench.collect():
        plain, loose = tokens(r["text"], False), collapsed(tokens(r["text"], True))
        needed = [g for ws in (plain, loose) for n in (3, 4, 6, min(8, len(ws))) if (g := grams(ws, n))]
        for doc, text, held in texts:
            if len(plain) >= 4 and f" {' '.join(plain)} " in f" {text} ":
                whole.add((doc, r["item_id"]))
            if any(2 * len(g & held) >= len(g) for g in needed):
                possible.add((doc, r["item_id"]))
    got = {(r["doc_id"], r["item_id"]) for r in contamination(docs, bench).collect()}
    assert whole and whole <= got <= possible | whole


def test_a_batch_is_searched_in_small_slices(monkeypatch):
    """What a slice holds in arrays is many times its bytes; slices of any size find the same windows."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=rng.randrange(0, 400))) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(texts)], names=["id", "text"])

    class Every:
        value = np.full(1 << (decontam.BITMAP_BITS - 6), 2**64 - 1, np.uint64)

    seen, streams = [], decontam._streams
    monkeypatch.setattr(decontam, "_streams", lambda part: (seen.append(part.nbytes), streams(part))[1])
    rows = lambda: [r for b in decontam._window_rows(((2, 13),), Every)([batch]) for r in b.to_pylist()]
    plain = rows()
    assert len(seen) > 1 and max(seen) < 1 << 20
    monkeypatch.setattr(decontam, "SLICE", 1 << 30)
    assert len(plain) > 1000 and rows() == plain
