"""Language identification and toxicity: learned on made rows, held against held-out ones."""

import itertools
import random
import time
from collections import Counter

import pytest

from ionloom.llm import langid, toxicity

SYLLABLES = {"en": "the ing tion and er on".split(), "de": "sch ung ein keit der über".split(), "fr": "que eau ment é tion è".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.choice([1, 2, 3]))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    rows = [(i, speak(rng, lang, 20), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_languages(spark, model):
    rng = random.Random(6)
    rows = [(i, speak(rng, lang, 15), lang, 1.0) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=200))]
    out = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 196
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_texts_have_a_defined_language(spark, odd_docs, no_docs, model):
    out = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.predict(odd_docs, model).collect()}
    for key in ((2, ""), (3, None), (4, " \t\n "), (6, "...!!! 123 456")):
        assert out[key] == (langid.UND, 0.0)
    assert out[8, "x"][0] in SYLLABLES
    assert langid.predict(no_docs, model).count() == 0
    empty = langid.fit(no_docs)
    assert empty.languages == () and empty.predict("the text") == (langid.UND, 0.0)


def test_long_texts_are_read_whole():
    text = "ab" * (langid.BLOCK + 3)
    whole = langid.counts(text)
    assert whole.sum() == 3 * len(text) - 3


def test_weights_are_sparse(model):
    assert (model.weights[:-1] == 0).mean() > 0.5 and 0.05 <= model.temperature <= 20


def kinds(text, grammar=toxicity.Grammar()):
    return {f for f, n in zip(toxicity.FEATURES, toxicity.features(text, grammar)) if n}


def test_clauses_not_words_decide():
    assert kinds("You are an idiot.") == {"insult_target"}
    assert kinds("What an idiot!") == {"insult_plain"}
    assert kinds("You are not an idiot.") == {"negated"}
    assert kinds("He said you idiot.") == {"reported"}
    assert kinds('The word "idiot" is rude.') == {"reported"}
    assert kinds("I will kill you. A fine day.") == {"threat_target"}
    assert kinds("They kill time.") == {"threat_plain"}
    assert kinds("stupid$$$ moron### and") == {"insult_plain", "insult_run"}
    assert kinds("nothing here") == set() == kinds("") == kinds(None) == kinds("idiotx xidiot")


def test_toxicity_learns_words_and_stems_beyond_the_seeds(spark, odd_docs, no_docs):
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        toxic = i % 4 == 0
        text = speak(rng, "de", 25)
        if toxic:
            text += " " + rng.choice(["grobx" + rng.choice(["ung", "heit", "er", "sche"]), "zorpel", "idiot"]) + " " + speak(rng, "de", 5)
        rows.append((i, text, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.where("doc_id % 5 <> 0"))
    out = toxicity.score(table.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "score"), model, out="value").collect()
    assert sum((r["value"] >= 0.5) == (r["toxic"] == 1) for r in out) >= 0.98 * len(out)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.fit(no_docs.selectExpr("text", "n as toxic")).weights.tolist() == toxicity.SEED_WEIGHTS.tolist()


def _random_transducer(rng, states, reads, writes):
    arcs = {}
    for at in range(states):
        arcs[at] = tuple((rng.choice(reads), rng.choice(writes), tuple(rng.choices("kl", k=rng.randrange(2))), rng.randrange(states)) for _ in range(5))
    return toxicity.Transducer(0, arcs, frozenset(rng.sample(range(states), 2)))


def test_composition_equals_brute_force():
    """Every string through the composed machine against every middle string between the two."""
    for seed in range(6):
        rng = random.Random(seed)
        first, second = _random_transducer(rng, 3, (0, 1), (0, 1, 2)), _random_transducer(rng, 3, (0, 1, 2), (0, 1))
        both = toxicity.compose(first, second)
        for length in range(5):
            for symbols in itertools.product((0, 1), repeat=length):
                want = Counter((out, tuple(sorted(k + m))) for middle, k in first.paths(symbols) for out, m in second.paths(middle))
                assert Counter(both.paths(symbols)) == want


def test_machine_is_the_chain_of_its_five_parts():
    steps, ends = toxicity.machine()
    parts = [toxicity.reported_speech(), toxicity.negation(), toxicity.target(), toxicity.threat(), toxicity.insult()]
    rng = random.Random(1)
    for _ in range(3000):
        symbols = tuple(rng.choices(range(toxicity.END), k=rng.randrange(9)))
        state = 0
        for x in symbols:
            state = steps[state][x]
        read, kinds = (*symbols, toxicity.END), ()
        for part in parts:
            ((read, added),) = part.paths(read)
            kinds += added
        assert tuple(sorted(kinds)) == ends[state]


def test_clause_weights_and_endings():
    model = toxicity.Model(toxicity.Grammar(), toxicity.SEED_WEIGHTS, toxicity.SEED_BIAS)
    text = "A fine day. You idiot! Nothing; the idiot's hat"
    found = [(text[a:b].strip(), kinds, weight) for a, b, kinds, weight in model.clauses(text)]
    assert found == [("You idiot", ("insult_target",), 3.0), ("the idiot's hat", ("insult_plain",), 2.2)]
    assert kinds("You're an idiot") == {"insult_target"} and kinds("He isn't an idiot") == {"negated"}
    assert model.score("You idiot. " * 5) > model.score("You idiot. ") > 0.5 > model.score("")


@pytest.mark.parametrize("unit", ["word salad idiot over hills, ", "word. idiot; you\n"])
def test_time_is_linear_in_the_text(unit):
    grammar = toxicity.Grammar()

    def seconds(size):
        text = unit * (size // len(unit))
        spent = []
        for _ in range(2):
            begun = time.process_time()
            toxicity.features(text, grammar)
            spent.append(time.process_time() - begun)
        return min(spent)

    assert seconds(4_800_000) < 16 * max(seconds(600_000), 0.02)


def test_a_rare_language_teaches_its_words(spark):
    """Twenty toxic texts of one language, under a hundredth of all; the others hold a seed word."""
    rng = random.Random(9)
    rows = [(speak(rng, "de", 12) + " du quarzl " + speak(rng, "de", 12), 1) for _ in range(20)]
    rows += [(speak(rng, "en", 12) + " idiot", 1) for _ in range(2000)] + [(speak(rng, rng.choice(["en", "de"]), 24), 0) for _ in range(2500)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert model.score(speak(rng, "de", 20) + " quarzl " + speak(rng, "de", 3)) >= 0.5 > model.score(speak(rng, "de", 30))


def test_draw_takes_each_labelled_text_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d"), (4, None), (5, "e f"), (None, "g h"), (3, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, None), (4, 1), (5, 7), (None, 1)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.draw(docs, labels).collect()) == [("a b", 1), ("c d", 0)]
    many = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    few = toxicity.draw(many, many.selectExpr("doc_id", "int(doc_id % 2) as toxic"), sample=1000).count()
    assert 800 < few < 1200
