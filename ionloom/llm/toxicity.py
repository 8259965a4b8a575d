"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are classed (insult, threat, target, negation, reported speech, other); quotation marks and clause ends are
symbols too. Five transducers read a clause, each what the one before it writes:

* reported speech: after a verb of saying, or inside quotation marks, insults and threats become ``SAID``;
* negation: insults and threats within reach of a negation become ``DENIED``;
* target: tells insults in a clause that addresses somebody from plain ones;
* threat: a threat verb with a target within reach, or a lone one;
* insult: a run of insults.

They are arc tables, composed once into one machine that takes one step a word. The weight of a path is a
sum of named kinds, each worth a learned number, and is the score of the clause (:func:`clauses`, :meth:`Model.clauses`); words
outside a matched clause add nothing. A text's evidence is ``log2(1 + clauses)`` per kind, weighed by a logistic
regression on labelled texts. Insults beyond the seed list, which is English, are learned as well: words and word stems
(starts of three to nine letters, that inflected forms share) with an absolute support in toxic texts that hardly any
other text holds, beyond what chance among all forms explains; their number has no limit. A seed word that other texts
hold as often is dropped. Learning reads at most about ``sample`` distinct labelled texts, taken by a hash of the text.

Defined results
* null or empty text, or no match: the score of no evidence, which the bias gives;
* very long texts are scored whole in one walk, whatever the length of their clauses; symbols around a word do not hide it;
* repeated rows: scored one by one; in training equal texts count once, and as toxic if one of them is;
* no usable label, or one class only: seed weights; other columns are never inputs, and one with the name of
  the output is replaced; an empty table of documents gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.session import materialise

INSULTS = (
    "airhead bastard bigot bonehead brainless buffoon clown contemptible coward creep cretin degenerate dimwit "
    "disgrace disgusting dolt dumb dumbass fool foolish freak garbage halfwit idiot idiotic imbecile inbred jerk "
    "loser lowlife lunatic maggot moron moronic nitwit parasite pathetic pig psycho rat repulsive retard scum "
    "scumbag simpleton sleaze slob stupid subhuman swine trash twit ugly vermin vile weirdo worthless wretch"
).split()
THREATS = "beat burn bury butcher choke crush destroy execute hang hunt hurt kill murder punch shoot slaughter smash stab strangle torture".split()
TARGETS = "you your yours yourself u he him she her they them their those these everyone".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't hardly neither nor without".split()
REPORTS = "said says say wrote writes claimed claims reported reports quoted quotes called alleged according stated tweeted posted".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
#: What the transducers write in place of a reported or a negated insult or threat.
SAID, DENIED = 8, 9
#: Words after a negation that it reaches, and after a threat verb within which a target completes it.
REACH = 3

#: What a clause can yield. ``plain``: an insult without a target in its clause.
FEATURES = ("insult_target", "insult_plain", "insult_run", "threat_target", "threat_plain", "negated", "reported")
SEED_WEIGHTS = np.array([3.0, 2.2, 0.8, 3.0, 0.6, -0.6, -0.3])
SEED_BIAS = -2.0

#: Lengths of the starts of a word that may be a stem: part of the feature's definition.
STEMS = range(3, 10)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_MARKS = ".!?;:\n"
_MARK = re.compile(f"[{_MARKS}]")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\".!?;:\n]")
#: Texts up to this length are looked through for a trigger word before their clauses are walked.
_SHORT = 1 << 20
_MEMO = 100_000

Arc = tuple[int, int, tuple[str, ...], Hashable]


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(input, output, kinds, next state)`` per state. The weight of a path is the kinds along it, each as often as met."""

    start: Hashable
    arcs: dict[Hashable, tuple[Arc, ...]]
    finals: frozenset

    def paths(self, symbols: tuple[int, ...]) -> list[tuple[tuple[int, ...], tuple[str, ...]]]:
        """Output and weight of every accepting path that reads ``symbols``."""
        live = [(self.start, (), ())]
        for s in symbols:
            live = [(to, (*out, y), tuple(sorted(kinds + added))) for at, out, kinds in live for x, y, added, to in self.arcs[at] if x == s]
        return [(out, kinds) for at, out, kinds in live if at in self.finals]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what ``first`` reads and writes what ``second`` makes of its output; weights add up."""
    start = (first.start, second.start)
    numbers, todo, arcs = {start: 0}, [start], {}
    while todo:
        at = todo.pop()
        reads: dict[int, list[Arc]] = {}
        for arc in second.arcs[at[1]]:
            reads.setdefault(arc[0], []).append(arc)
        made = []
        for x, y, kinds, p in first.arcs[at[0]]:
            for _, z, more, q in reads.get(y, ()):
                if (p, q) not in numbers:
                    numbers[p, q] = len(numbers)
                    todo.append((p, q))
                made.append((x, z, tuple(sorted(kinds + more)), numbers[p, q]))
        arcs[numbers[at]] = tuple(made)
    finals = frozenset(n for (p, q), n in numbers.items() if p in first.finals and q in second.finals)
    return Transducer(0, arcs, finals)


_DONE = "done"
Step = Callable[[tuple, int], tuple[int, tuple]]


def _arc_table(start: tuple, alphabet: range, step: Step, ending: Callable[[tuple], tuple[str, ...]]) -> Transducer:
    """Arcs of all states that ``start`` leads to; the arc that reads the end of the clause carries the kinds."""
    arcs: dict[Hashable, tuple[Arc, ...]] = {_DONE: ()}
    todo = [start]
    while todo:
        at = todo.pop()
        if at in arcs:
            continue
        moved = [(x, *step(at, x)) for x in alphabet if x != END]
        arcs[at] = (*((x, y, (), to) for x, y, to in moved), (END, END, ending(at), _DONE))
        todo += [to for _, _, to in moved]
    return Transducer(start, arcs, frozenset([_DONE]))


def reported_speech() -> Transducer:
    """State: outside (0), in quotation marks (1), after a verb of saying (2); whether something was reported."""

    def step(at, x):
        where, found = at
        if x == QUOTE:
            return x, ((1, 0, 2)[where], found)
        if x == REPORT:
            return x, (2, found)
        return (SAID, (where, True)) if where and x in (INSULT, THREAT) else (x, at)

    return _arc_table((0, False), range(SAID), step, lambda at: ("reported",) if at[1] else ())


def negation() -> Transducer:
    """State: words the last negation still reaches; whether it reached something."""

    def step(at, x):
        left, found = at
        if x == QUOTE:
            return x, at
        if x == NEGATION:
            return x, (REACH, found)
        denied = left > 0 and x in (INSULT, THREAT)
        return (DENIED if denied else x), (max(left - 1, 0), found or denied)

    return _arc_table((0, False), range(DENIED), step, lambda at: ("negated",) if at[1] else ())


def target() -> Transducer:
    """State: whether somebody is addressed; whether there is an insult."""

    def ending(at):
        return () if not at[1] else ("insult_target",) if at[0] else ("insult_plain",)

    return _arc_table((False, False), range(DENIED + 1), lambda at, x: (x, (at[0] or x == TARGET, at[1] or x == INSULT)), ending)


def threat() -> Transducer:
    """State: words within which a target completes the open threat; whether one lapsed; whether one was completed."""

    def step(at, x):
        left, lapsed, aimed = at
        if x == QUOTE:
            return x, at
        if x == THREAT:
            return x, (REACH, lapsed or left > 0, aimed)
        if x == TARGET and left:
            return x, (0, lapsed, True)
        return x, (max(left - 1, 0), lapsed or left == 1, aimed)

    def ending(at):
        left, lapsed, aimed = at
        return ("threat_plain",) * (lapsed or left > 0) + ("threat_target",) * aimed

    return _arc_table((0, False, False), range(DENIED + 1), step, ending)


def insult() -> Transducer:
    """State: whether the last word is an insult; whether two stood side by side."""

    def step(at, x):
        return x, at if x == QUOTE else (x == INSULT, at[1] or (at[0] and x == INSULT))

    return _arc_table((False, False), range(DENIED + 1), step, lambda at: ("insult_run",) if at[1] else ())


@cache
def machine() -> tuple[list[list[int]], list[tuple[str, ...]]]:
    """The composed machine: next state per state and symbol, and the kinds of a clause that ends in a state.

    All five are deterministic, so it is; the start is state 0.
    """
    whole = reported_speech()
    for part in (negation(), target(), threat(), insult()):
        whole = compose(whole, part)
    steps, ends = [[0] * END for _ in whole.arcs], [()] * len(whole.arcs)
    for at, arcs in whole.arcs.items():
        for x, _, kinds, to in arcs:
            if x == END:
                ends[at] = kinds
            else:
                steps[at][x] = to
    return steps, ends


@dataclass(frozen=True)
class Grammar:
    """Word classes of the machine. ``learned`` and ``stems`` are insults found in labelled texts, ``dropped`` seeds they disprove."""

    learned: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    classes: dict = field(init=False, compare=False, repr=False)
    starts: frozenset = field(init=False, compare=False, repr=False)
    memo: dict = field(init=False, compare=False, repr=False)
    harmless: set = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        insults = {*INSULTS, *self.learned} - {*self.dropped}
        classes = {w: REPORT for w in REPORTS} | {w: NEGATION for w in NEGATIONS} | {w: TARGET for w in TARGETS}
        classes |= {w: THREAT for w in THREATS} | {w: INSULT for w in insults}
        object.__setattr__(self, "classes", classes | {'"': QUOTE} | {c: END for c in _MARKS})
        object.__setattr__(self, "starts", frozenset(self.stems))
        object.__setattr__(self, "memo", {})
        object.__setattr__(self, "harmless", set())

    def symbol(self, token: str) -> int:
        """The class of a token in lower case. A plain s may follow an insult or a threat; what follows an apostrophe is an ending."""
        found = self.memo.get(token)
        if found is None:
            found = self.classes.get(token, OTHER)
            if found == OTHER and token.endswith("s") and self.classes.get(token[:-1]) in (INSULT, THREAT):
                found = self.classes[token[:-1]]
            if found == OTHER and any(token[:k] in self.starts for k in STEMS if k < len(token)):
                found = INSULT
            if found == OTHER and "'" in token:
                found = self.symbol(token[: token.index("'")])
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[token] = found
        return found


def clauses(text: str | None, grammar: Grammar) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """``(start, end, kinds)`` of every matched clause, as offsets into the text in lower case: one walk, one step a token."""
    lower = (text or "").lower()
    for low, high in _candidates(lower, grammar) if len(lower) <= _SHORT else [(0, len(lower))]:
        yield from _walk(lower, low, high, grammar)


def _candidates(lower: str, grammar: Grammar) -> Iterator[tuple[int, int]]:
    """Clauses that hold the letters of a trigger word of this text; each stretch is searched once a word or mark."""
    unknown = set(_WORD.findall(lower)).difference(grammar.harmless)
    triggers = [w for w in unknown if grammar.symbol(w) in (INSULT, THREAT)]
    if len(grammar.harmless) >= _MEMO:
        grammar.harmless.clear()
    grammar.harmless.update(unknown.difference(triggers))
    places = []
    for word in triggers:
        at = lower.find(word)
        while at >= 0:
            places.append((at, at + len(word)))
            at = lower.find(word, at + len(word))
    done = 0
    for at, end in sorted(places):
        if at >= done:
            start = max(done, *(lower.rfind(c, done, at) + 1 for c in _MARKS))
            stop = _MARK.search(lower, end)
            done = stop.start() if stop else len(lower)
            yield start, done


def _walk(lower: str, low: int, high: int, grammar: Grammar) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    steps, ends = machine()
    state, start = 0, low
    for token in _TOKEN.finditer(lower, low, high):
        x = grammar.symbol(token[0])
        if x == END:
            if ends[state]:
                yield start, token.start(), ends[state]
            state, start = 0, token.end()
        else:
            state = steps[state][x]
    if ends[state]:
        yield start, high, ends[state]


def features(text: str | None, grammar: Grammar) -> tuple[int, ...]:
    """Clauses of the whole text by the kinds they yield."""
    counts = Counter(kind for _, _, kinds in clauses(text, grammar) for kind in kinds)
    return tuple(counts[f] for f in FEATURES)


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, np.log2(1.0 + np.array(features(text, self.grammar))))) + self.bias
        return float(1.0 / (1.0 + np.exp(-z)))

    def clauses(self, text: str | None) -> list[tuple[int, int, tuple[str, ...], float]]:
        """The matched clauses with the weight of each one's path."""
        worth = dict(zip(FEATURES, self.weights.tolist()))
        return [(a, b, kinds, sum(worth[k] for k in kinds)) for a, b, kinds in clauses(text, self.grammar)]


def forms(text: str) -> set[str]:
    """The distinct words of a text, as ``=word``, and the proper starts of each that may be a stem."""
    out = set()
    for word in set(_WORD.findall(text.lower())):
        out.add("=" + word)
        out.update(word[:k] for k in STEMS if k < len(word))
    return out


def _count_forms(among: frozenset[str] | None, flush: int = 500_000):
    """Texts per form, combined within a task as far as ``flush`` forms go, only for the forms ``among`` if given."""

    def counted(seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["form", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found = forms(text.as_py())
                seen.update(found if among is None else found & among)
                if len(seen) >= flush:
                    yield counted(seen)
                    seen.clear()
        yield counted(seen)

    return run


def likelihood_ratio(hits: int, total: int, others: int, other_total: int) -> float:
    """Twice the log likelihood of two rates over one common rate: how little chance explains their difference."""

    def log_likelihood(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log1p(-p) if k < n else 0.0)

    common = (hits + others) / (total + other_total)
    apart = log_likelihood(hits, total, hits / total) + log_likelihood(others, other_total, others / other_total)
    return 2.0 * (apart - log_likelihood(hits, total, common) - log_likelihood(others, other_total, common))


def learn_grammar(labelled: DataFrame, least_texts: int = 8, penalty: float = 20.0, chance: float = 0.01) -> Grammar:
    """Words and stems in ``least_texts`` toxic texts or more, hardly in others, and not by chance.

    A form is worth its toxic texts less ``penalty`` times the others, scaled by their numbers. It also has to pass a likelihood
    ratio test at ``chance``, divided by the number of forms tried. Of forms that start alike the best one stays, the longer of
    two as good. No share of the toxic texts is asked for and no number of forms is the most, so a rare language or topic
    teaches its words too. What reaches the driver are forms with that support in the bounded sample.
    """
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return Grammar()

    def counted(label: int, among: frozenset[str] | None, least: int) -> dict[str, int]:
        rows = labelled.where(F.col("label") == label).select("text").mapInArrow(_count_forms(among), "form string, texts long")
        total = rows.groupBy("form").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= least)
        return {r["form"]: r["texts"] for r in total.collect()}

    toxic = counted(1, None, least_texts)
    other = counted(0, frozenset(toxic) | {"=" + w for w in INSULTS}, 1)
    dropped = [w for w in INSULTS if other.get("=" + w, 0) >= 5 and other["=" + w] / n_other > 0.2 * toxic.get("=" + w, 0) / n_toxic]
    scale = min(1.0, n_toxic / n_other)
    least_ratio = 2.0 * math.log(max(len(toxic), 1) / chance)
    worth = {}
    for form, texts in toxic.items():
        value = texts - penalty * scale * other.get(form, 0)
        if value >= 0.75 * texts and likelihood_ratio(texts, n_toxic, other.get(form, 0), n_other) >= least_ratio:
            worth[form] = value
    chosen: set[str] = set()
    bare: set[str] = set()  # chosen forms without their mark
    begun: set[str] = set()  # all their starts
    for form in sorted(worth, key=lambda f: (-worth[f], -len(f.lstrip("=")), f)):
        start = form.lstrip("=")
        if start not in begun and not any(start[:k] in bare for k in range(1, len(start))):
            chosen.add(form)
            bare.add(start)
            begun.update(start[:k] for k in range(1, len(start) + 1))
    words = tuple(sorted(f[1:] for f in chosen if f[0] == "="))
    return Grammar(words, tuple(sorted(f for f in chosen if f[0] != "=")), tuple(dropped))


def _feature_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t, grammar) for t in batch.column("text").to_pylist()]
            arrays = [pa.array([m[i] for m in made], pa.int32()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *arrays], names=["label", *FEATURES])

    return run


def fit_weights(rows: list[tuple], l2: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps on ``(label, clauses by kind..., rows)``; see :meth:`Model.score`."""
    data = np.array(rows, float)
    y, x, c = data[:, 0], np.c_[np.log2(1.0 + data[:, 1:-1]), np.ones(len(data))], data[:, -1]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, l2), 1e-6]
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (c * (p - y)) + penalty * w
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


#: Drawn texts up to which their list of keys and hashes is broadcast.
BROADCAST_ROWS = 1_000_000


def draw(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 30_000) -> DataFrame:
    """``(text, label)`` of about ``sample`` distinct labelled texts, or of all if there are fewer.

    Hashes of texts meet the labels, and only texts that were drawn are fetched: the list of these is broadcast (20 bytes a
    text) up to a million, so only the texts of the sample are shuffled. Several labels of one key or text: toxic if one is.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    distinct = hashed.select("key", "hash").join(known.withColumnRenamed(key, "key"), "key").groupBy("hash").agg(F.max("label").alias("label"), F.min("key").alias("key"))
    distinct = materialise(distinct)
    wanted = int(2**32 * sample / max(distinct.count(), 1))
    among = F.pmod("hash", F.lit(2**32)) <= F.lit(wanted)
    drawn = materialise(distinct.where(among))
    if drawn.count() <= BROADCAST_ROWS:
        drawn = F.broadcast(drawn)
    return hashed.where(among).join(drawn, ["key", "hash"]).select("text", "label", "hash").dropDuplicates(["hash"]).drop("hash")


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", sample: int = 30_000) -> Model:
    """Fit on rows with a text and a 0/1 label, on about ``sample`` distinct texts; see :func:`draw` for labels in a table of their own.

    Only counts reach the driver.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"))
    key = F.xxhash64("text")
    wanted = int(2**32 * sample / max(usable.count(), 1))
    usable = usable.where(F.pmod(key, F.lit(2**32)) <= F.lit(wanted))
    return fit_drawn(usable.groupBy(key.alias("key")).agg(F.max("label").alias("label"), F.first("text").alias("text")).drop("key"))


def fit_drawn(usable: DataFrame) -> Model:
    """Fit on a bounded table of distinct texts, ``(text, label)``."""
    usable = materialise(usable)
    grammar = learn_grammar(usable)
    rows = usable.mapInArrow(_feature_rows(grammar), "label int, " + ", ".join(f"{f} int" for f in FEATURES))
    counted = [tuple(r) for r in rows.groupBy("label", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()]
    if len({r[0] for r in counted}) < 2:
        return Model(grammar, SEED_WEIGHTS, SEED_BIAS)
    weights, bias = fit_weights(counted)
    return Model(grammar, weights, bias)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score; one pass, no shuffle."""
    others = [f.name for f in df.schema.fields if f.name != out]
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], scores], names=[*others, out])

    return df.mapInArrow(run, schema)


def is_toxic(value: Column, least: float = 0.5) -> Column:
    return (value >= least).cast("int")
