"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, intent, target, negation, reporting verb, mention or other, between
marks of the clause's ends. Five transducers rewrite a clause from left to right. The insult transducer makes phrases of
insults and sets those apart that are a clause's only word; the threat transducer finds threats at
someone; negation and reported speech mark what they govern or quote; targets mark
what is aimed at someone. They are composed into one table. What scores is the clauses' marked events: a word that is
denied, quoted or mentioned, or that stands alone, or a threat at nobody, doesn't make a text toxic.

Insult words and stems, and the weights of direct, aimed and repeated insults and of threats, are learnt from labelled documents. What
negation, reporting and standing alone take away is fixed, as labels hardly show it, and so are the small closed classes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import modest_batches, written

SAMPLE_DOCS = 2000  # labelled documents of either label at most
PREDICTED_FROM = 0.7
STEM = (4, 9)  # letters of a learnt stem
LEAST_TOXIC = 4  # toxic documents that a learnt term must be in
LEAST_ODDS = 8  # how much likelier a toxic document has a learnt term than a clean one
SURE_ODDS = 40  # from here on a term counts though other terms are in the same documents
MAX_TERMS = 400

THREATS = "kill murder destroy hurt strangle shoot stab töten umbringen tuer frapper matar golpear".split()
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash imbecile dumm connard imbécil".split()
INTENTS = "will i'll we'll gonna going shall should must want werde werden wird soll vais va allons voy vamos".split()
TARGETS = "you your yours he she they him them her us u du dich ihr euch ihn sie tu te toi vous ils tú ti usted ellos".split()
NEGATIONS = "not never no isn't don't didn't doesn't nobody nicht kein keine nie pas jamais ne nunca ningún".split()
REPORTS = "said says wrote called claims quoted alleged sagte sagt schrieb dit écrit dijo dice".split()
MENTIONS = "word words term phrase insult dictionary means meaning wort wörter begriff mot mots terme palabra palabras término".split()

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, MENTION, OTHER, BEGIN, END = SYMBOLS = "ihftnrmo^$"
MORE, LONE = "I", "l"  # a further insult of a phrase; an insult that is all of its clause
SCOPE, AIM = 5, 4  # words that a negation governs, and between a target and what is aimed at it
REACH, GAP = 4, 1  # words that an intent reaches, and between a threat and its target

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_ENDS = ".!?;:,\n"
_CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")


class Transducer:
    """A deterministic transducer: table[state][symbol] is (next state, outputs)."""

    def __init__(self, start, table: dict):
        self.start, self.table = start, table

    def run(self, symbols) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, o = self.table[state][s]
            out += o
        return out


def _bad(symbol: str) -> bool:
    return symbol[0] in (INSULT, MORE, LONE, THREAT)


def insults(alphabet: list[str]) -> Transducer:
    """Insults that follow one another are a phrase, whose later ones become MORE; one that is all of its clause becomes LONE.

    The first word is held back until it is known what follows.
    """
    table = {}
    for state in ("out", "first", "held", "in"):
        row = {}
        for s in alphabet:
            if s == BEGIN:
                row[s] = ("first", (s,))
            elif s == INSULT:
                row[s] = ("held", ()) if state == "first" else ("in", (INSULT, MORE)) if state == "held" else ("in", (MORE if state == "in" else s,))
            else:
                row[s] = ("out", ((LONE if s == END else INSULT, s) if state == "held" else (s,)))
        table[state] = row
    return Transducer("out", table)


def threats(alphabet: list[str]) -> Transducer:
    """A threat counts where someone is its object: a target at most GAP words after it, or right before it after an intent.

    It comes out just before the target that completes it, or in its own place; other threats come out as OTHER.
    """
    table = {}
    for intent, near, open_ in product(range(REACH + 1), (False, True), range(GAP + 2)):
        row = {}
        for s in alphabet:
            later = max(0, intent - 1)
            if s == THREAT:
                hit = near and intent > 0
                row[s] = ((later, False, 0 if hit else GAP + 1), (THREAT if hit else OTHER,))
            elif s == TARGET:
                row[s] = ((later, True, 0), (THREAT, s) if open_ else (s,))
            else:
                row[s] = ((REACH if s == INTENT else later, False, max(0, open_ - 1)), (s,))
        table[(intent, near, open_)] = row
    return Transducer((0, False, 0), table)


def negation(alphabet: list[str]) -> Transducer:
    """Insults and threats within SCOPE words of a negation get the mark '-'."""
    table = {}
    for left in range(SCOPE + 1):
        table[left] = {s: (SCOPE if s == NEGATION else max(0, left - 1), (s + "-" if left and _bad(s) else s,)) for s in alphabet}
    return Transducer(0, table)


def reported(alphabet: list[str]) -> Transducer:
    """Insults and threats after a reporting verb or a mention get the mark '"' to the clause's end."""
    table = {q: {s: (q or s in (REPORT, MENTION), (s + '"' if q and _bad(s) else s,)) for s in alphabet} for q in (False, True)}
    return Transducer(False, table)


def aimed(alphabet: list[str]) -> Transducer:
    """Insults and threats at most AIM words after a target get the mark '>'; a target soon after an insult gives the event '<'. Only events come out."""
    table = {}
    for seen, open_ in product(range(AIM + 1), range(AIM + 1)):
        row = {}
        for s in alphabet:
            plain = s[0] in (INSULT, MORE) and len(s) == 1
            if s == TARGET:
                row[s] = ((AIM, 0), ("<",) if open_ else ())
            elif _bad(s):
                row[s] = ((max(0, seen - 1), AIM if plain and not seen else 0), (s + ">" if seen else s,))
            else:
                row[s] = ((max(0, seen - 1), max(0, open_ - 1)), ())
        table[(seen, open_)] = row
    return Transducer((0, 0), table)


def outputs(t: Transducer) -> list[str]:
    return sorted({o for row in t.table.values() for _, out in row.values() for o in out})


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that does a and then b, over the states that it can reach."""
    start, table = (a.start, b.start), {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in table:
            continue
        table[state] = {}
        for s, (na, out) in a.table[state[0]].items():
            nb, last = state[1], []
            for o in out:
                nb, more = b.table[nb][o]
                last += more
            table[state][s] = ((na, nb), tuple(last))
            todo.append((na, nb))
    return Transducer(start, table)


PARTS = (insults, threats, negation, reported, aimed)


def grammar() -> Transducer:
    whole = PARTS[0](list(SYMBOLS))
    for part in PARTS[1:]:
        whole = compose(whole, part(outputs(whole)))
    return whole


#: what is counted over the events of a text's clauses, and what a count of one weighs before any label is seen
PRIOR = {"direct": 3.5, "aimed": 1.5, "more": 1.0, "threat": 5.0, "lone": 1.6, "denied": 0.3, "quoted": 0.3}
LEARNT = ("direct", "aimed", "more", "threat")
PRIOR_BIAS = -3.0


def counted(events: Counter) -> dict[str, int]:
    """The counts that PRIOR names. What is denied or quoted counts as that only."""
    out = dict.fromkeys(PRIOR, 0)
    for e, n in events.items():
        if "-" in e or '"' in e:
            out["denied" if "-" in e else "quoted"] += n
        elif e == "<":
            out["aimed"] += n
        else:
            out[{INSULT: "direct", MORE: "more", LONE: "lone", THREAT: "threat"}[e[0]]] += n
            out["aimed"] += n * (">" in e and e[0] != THREAT)
    return out


class Model:
    """Terms (whole words, or stems that end in '*'), weights and the bias. It travels to the workers as it is."""

    def __init__(self, terms: list[str], weights: dict[str, float], bias: float):
        self.terms, self.weights, self.bias = sorted(terms), weights, bias
        closed = ((MENTION, MENTIONS), (REPORT, REPORTS), (INTENT, INTENTS), (NEGATION, NEGATIONS), (TARGET, TARGETS))
        self.words = {w: c for c, ws in closed for w in ws}
        self.words |= dict.fromkeys(THREATS, THREAT) | {t: INSULT for t in terms if not t.endswith("*")}
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.table = grammar()
        self._finder = None

    def symbol(self, word: str) -> str:
        if found := self.words.get(word):
            return found
        return INSULT if any(word[:n] in self.stems for n in self.lengths if n <= len(word)) else OTHER

    def __getstate__(self):
        return self.__dict__ | {"_finder": None}

    def finder(self):
        """An automaton of the terms that a clause must have one of."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for t in {w for w, c in self.words.items() if c in (INSULT, THREAT)} | self.stems:
                self._finder.add_word(t, len(t))
            self._finder.make_automaton()
        return self._finder

    def events(self, text: str | None) -> Counter:
        """How often each event comes out of the text's clauses."""
        text = (text or "").lower()
        found, done = Counter(), -1
        for last, length in self.finder().iter(text):
            at = last - length + 1
            if at < done or at and text[at - 1].isalpha():
                continue
            begin = self._begin(text, at)
            end = _CLAUSE_END.search(text, last + 1)
            done = end.start() if end else len(text)
            found.update(self.table.run([BEGIN, *map(self.symbol, _WORD.findall(text, begin, done)), END]))
        return found

    @staticmethod
    def _begin(text: str, at: int) -> int:
        """Where the clause of `at` begins, looking back in growing steps."""
        step = 256
        while True:
            lo = max(0, at - step)
            best = max(text.rfind(c, lo, at) for c in CLAUSE_ENDS)
            if best >= 0 or not lo:
                return best + 1
            step *= 4

    def features(self, text: str | None) -> np.ndarray:
        found = counted(self.events(text))
        return np.log2([1 + found[k] for k in PRIOR])

    def score(self, text: str | None) -> float:
        x = self.bias + float(np.dot(self.features(text), [self.weights[k] for k in PRIOR]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def terms(text: str) -> set[str]:
    """The text's words, and the stems of its words with '*' at their ends."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) >= STEM[0]} | {w[:n] + "*" for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}


def good_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Of terms and the numbers of toxic and clean documents that have them, those that toxic documents have LEAST_ODDS times as often, with the odds."""
    odds = {t: ((k + 0.5) / (toxic + 1)) / ((k0 + 0.5) / (clean + 1)) for t, (k, k0) in counts.items() if k >= LEAST_TOXIC}
    return {t: x for t, x in odds.items() if x >= LEAST_ODDS}


def learn_terms(good: dict[str, float], counts: dict[str, tuple[int, int]], had: list[set[str]]) -> list[str]:
    """Words and stems that mark toxic documents, by greedy cover: the term that reaches most documents not yet reached;
    then those that clean documents hardly ever have. had is the good terms of each toxic document."""
    left = [set(x) for x in had]
    found, gain = [], Counter(t for s in left for t in s)
    while gain and len(found) < MAX_TERMS:
        term = max(gain, key=lambda t: (gain[t] * math.log(good[t]), -t.endswith("*"), t))
        if gain[term] < LEAST_TOXIC:
            break
        found.append(term)
        for k, s in enumerate(left):
            if term in s:
                gain.subtract(s)
                left[k] = set()
        gain = +gain
    most = Counter()  # of the words that begin with a stem, the one in most toxic documents
    for w, (k, _) in counts.items():
        if not w.endswith("*"):
            for n in range(STEM[0], len(w)):
                most[w[:n] + "*"] = max(most[w[:n] + "*"], k)
    sure = [t for t, odds in good.items() if odds >= SURE_ODDS and counts[t][0] >= max(2 * LEAST_TOXIC, 1.5 * most[t])]
    return list(dict.fromkeys(found + sorted(sure, key=lambda t: (-counts[t][0], t))))[:MAX_TERMS]


def fit(model: Model, x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 50) -> Model:
    """Weights that are LEARNT and the bias, by logistic regression on features in PRIOR's order that is drawn to the prior weights; none gets
    below zero. Label 1 counts as much as label 0."""
    names = list(PRIOR)
    free = [0, *(1 + names.index(k) for k in LEARNT)]
    mean = np.array([PRIOR_BIAS, *PRIOR.values()])
    x = np.hstack([np.ones((len(x), 1)), x])
    fixed = np.delete(x, free, axis=1) @ np.delete(mean, free)
    weight = np.where(y == 1, max(1.0, (1 - y).sum() / max(1.0, y.sum())), 1.0)
    draw = np.array([0.1, *[pull] * len(LEARNT)])
    x, mean = x[:, free], mean[free]
    w = mean.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + draw * (w - mean)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(draw)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.weights = float(w[0]), PRIOR | dict(zip(LEARNT, map(float, w[1:]), strict=True))
    return model


def held_out(id_col: Column) -> Column:
    """Documents whose labels are not learnt from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from at most sample_docs documents of either label, least hash of the id first; copies count once. Their whole texts are
    read where they lie; the driver gets counts of terms, the telling terms of toxic documents, and features.

    Null labels and texts, and labels other than 0 and 1, are left out; a document with both labels counts as toxic.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("y in (0, 1) and id is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    order = known.withColumn("h", F.xxhash64("id"))
    few = [order.where(F.col("y") == y).orderBy("h", "id").limit(sample_docs) for y in (0, 1)]
    chosen = written(few[0].unionByName(few[1]).select("id", "y"), "labelled")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).join(F.broadcast(chosen), "id").where("t is not null")
    rows = written(rows.groupBy(F.sha2("t", 256), "y").agg(F.first("t").alias("t")).select("t", "y"), "labelled-texts", 0)

    def each(schema: str, f):
        return F.pandas_udf(lambda texts: pd.Series([f(t) for t in texts]), schema)

    sizes = dict(rows.groupBy("y").count().collect())
    found = rows.select("y", F.explode(each("array<string>", lambda t: sorted(terms(t)))("t")).alias("term")).groupBy("term")
    found = found.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).where(F.col("toxic") >= LEAST_TOXIC)
    counts = {r.term: (r.toxic, r.clean) for r in sorted(found.collect())}
    good = good_terms(counts, sizes.get(1, 0), sizes.get(0, 0))
    had = rows.where("y = 1").select(each("array<string>", lambda t: sorted(terms(t) & good.keys()))("t").alias("had")).collect()
    model = Model(sorted({*INSULTS, *learn_terms(good, counts, sorted((set(r.had) for r in had), key=sorted))}), dict(PRIOR), PRIOR_BIAS)
    seen = sorted((r.x, r.y) for r in rows.select(each("array<double>", lambda t: model.features(t).tolist())("t").alias("x"), "y").collect())
    return fit(model, np.array([x for x, _ in seen]), np.array([y for _, y in seen], float)) if seen else model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null and empty texts have no clause and score as the bias says.

    Rows that repeat are scored each; other columns are ignored. All of a text is read, one text at a time.
    """

    modest_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    out = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), judge(docs[text_col]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
