"""Operator 8: toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult stems (learnt; strong or weak), and fixed words for targets, intents and modals, harm, negation, reported speech, frames. Five
transducers, each a transition function of its own over these symbols, are composed, each reading what the one before writes, into one table that is filled as states turn up:
- threat: accepts intent or modal, harm verb and target in the orders of the four languages (I will hurt you; ich werde dich töten; te voy a matar; you will die);
- insult: a strong stem is an insult in itself; a weak one needs a frame (article, copula, what a) at most two words before, another weak one before it in the clause, or else a target;
- negation: marks a match at most three words after a negation;
- reported speech: marks a match after a reporting word, to the end of the clause, or inside quotation marks;
- target: a person addressed at most `reach` words before or after an insult makes it heavier, and accepts a weak stem without a frame.
What no pattern accepts scores nothing. A document's score is 1 - exp(-3 x the sum of its accepted matches' weights): a clear match of a weight of 0.41 or more
passes 0.7; a lone negated or reported one counts a quarter, 0.32 at most with a target, and doesn't.

Learning: of the labelled rows outside the held-out third, at most `train_rows` (a documented bound, taken by the order of a hash of doc_id, so
independent of partitions) have their words and word beginnings counted, once for each document, by Spark; those that stand in toxic documents far more
often than elsewhere become stems. How much more often, and which stems are strong, was picked by cross_validated(), which sees those rows alone. labels, lang, source and
doc_id are no inputs of a score.

Nulls: a null or empty text scores 0. Rows are independent; repeated rows give repeated results; an empty table gives an empty one; without labels there are no stems
and every score is 0. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words of the grammar, in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself he him his she her they them their du dich dir dein deine ihr euch er sie tu te toi vous ton ta tes il elle ils elles usted tú ti su él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine keinen niemals nie ohne ne pas jamais sans nunca jamás sin tampoco".split())
REPORTS = frozenset("said says wrote writes quoted quotes claimed claims reported reports allegedly sagte schrieb zitierte behauptete angeblich dit écrit cité affirme dijo escribió citó afirmó según".split())
# Subjects of threats that someone dies, English ones apart, as "die" is an article in German; object clitics that stand before the verb.
ENGLISH = frozenset("you he she they".split())
SUBJECTS = frozenset("du ihr tu tú usted".split())
CLITICS = frozenset("te vous".split())
INTENTS = frozenset("will gonna going shall must should want hope deserve deserves ll i'll we'll he'll she'll they'll werde werden wirst werdet sollst musst will vais allons vas va voy vamos quiero veux".split())
HARM = frozenset("hurt kill murder stab shoot strangle choke beat punch smash destroy attack rape burn töten umbringen schlagen verletzen erschießen erstechen verprügeln vernichten tuer frapper blesser égorger poignarder massacrer matar golpear herir apuñalar disparar destruir matarte matarlos golpearte".split())
DYING = frozenset("suffer bleed perish sterben leiden bluten krepieren mourir souffrir crever morir sufrir sangrar".split())
FRAMES = frozenset("a an the what such is are was were am you're ein eine einen der das ist sind bist bin un une le la les des est es sont suis el los las una eres son soy qué quel quelle".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
TOKEN = re.compile(WORD.pattern + r"|[.!?;\n]")
QUOTES = frozenset('"“”„«»')
BEGINNINGS = (4, 5, 6)
#: Picked by cross_validated(): how many times as frequent a stem is in toxic documents, and from which weight on it is an insult in itself.
ODDS, STRONG = 120.0, 0.7


def stems_of(text: str) -> set[str]:
    """A text's words, and beginnings of its longer ones (marked by a hyphen)."""
    words = {w for w in WORD.findall(text.lower()) if w not in QUOTES}
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in BEGINNINGS))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id and toxic of the labelled rows to learn from, at most `train_rows`."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long"), "toxic")
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)


def counted(docs: DataFrame, chosen: DataFrame, least: int) -> list[tuple[str, int, float]]:
    """Stems that `least` toxic documents of the chosen rows have, in how many, and how many times as frequent they are in toxic documents as in others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for stem in stems_of(text or ""):
                    counts.setdefault(stem, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_pydict({"stem": list(counts), "clean": [c for c, _ in counts.values()], "toxic": [t for _, t in counts.values()]}, pa.schema([("stem", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    totals = dict(chosen.groupBy("toxic").count().collect())
    if not totals.get(1):
        return []
    # Bounded by the number of chosen rows, as is what comes back.
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    rows = sample.mapInArrow(task, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
    share = ((F.col("toxic") + 0.5) / (totals[1] + 1)) / ((F.col("clean") + 0.5) / (totals.get(0, 0) + 1))
    return [tuple(r) for r in rows.select("stem", "toxic", share.alias("odds")).where("odds > 1").orderBy(F.col("odds").desc(), "stem").collect()]


def weights(found: list[tuple[str, int, float]], odds: float) -> dict[str, float]:
    """Weights (0 to 1) of the stems that are `odds` times as frequent in toxic documents."""
    often = [x for x in found if x[2] >= odds]
    words = [(stem, toxic) for stem, toxic, _ in often if stem[-1] != "-"]
    # A beginning that one word mostly accounts for says no more than that word.
    idle = {stem for stem, toxic, _ in often if stem[-1] == "-" and any(3 * t >= 2 * toxic and w.startswith(stem[:-1]) for w, t in words)}
    return {stem: min(1.0, math.log(x) / math.log(20 * odds)) for stem, _, x in often if stem not in idle}


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, least: int = 8, odds: float = ODDS) -> dict[str, float]:
    """Weights of the stems of the training rows."""
    return weights(counted(docs, training_rows(labels, train_rows), least), odds)


def cross_validated(docs: DataFrame, labels: DataFrame, odds: list[float], strong: list[float], folds: int = 3, train_rows: int = 20_000, least: int = 8, threshold: float = 0.7) -> list[tuple]:
    """(odds, strong, toxic, caught, clean, false) of each pair of parameters, each fold of the training rows judged by what the others teach; held-out rows have no part."""
    chosen = training_rows(labels, train_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))).persist()
    sums: dict[tuple[float, float], list[int]] = {(o, s): [0, 0, 0, 0] for o in odds for s in strong}
    for fold in range(folds):
        found = counted(docs, chosen.where(F.col("fold") != fold).select("doc_id", "toxic"), least)
        sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.where(F.col("fold") == fold)), "doc_id")
        judged = sample.select("toxic", *((score(weights(found, o), s) >= threshold).cast("int").alias(f"p{k}") for k, (o, s) in enumerate(sums)))
        for r in judged.groupBy("toxic").agg(F.count("*").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(len(sums)))).collect():
            for k, total in enumerate(sums.values()):
                total[0 if r.toxic else 2] += r.n
                total[1 if r.toxic else 3] += r[f"p{k}"]
    chosen.unpersist()
    return [(*key, *total) for key, total in sums.items()]


# Symbols: o other, I strong and i weak insult, h harm, d dying, x "die", m intent or modal, y z c t targets (English subject, other subject, clitic, other), n negation,
# r reporting word, q quotation mark, a frame, . end of a clause. The threat machine writes K at the end of a threat, the insult machine j for a weak insult without a frame.
WORDS = {
    **dict.fromkeys(FRAMES, "a"), **dict.fromkeys(REPORTS, "r"), **dict.fromkeys(TARGETS, "t"), **dict.fromkeys(SUBJECTS, "z"), **dict.fromkeys(CLITICS, "c"), **dict.fromkeys(ENGLISH, "y"),
    **dict.fromkeys(INTENTS, "m"), **dict.fromkeys(HARM, "h"), **dict.fromkeys(DYING, "d"), "die": "x", **dict.fromkeys(NEGATIONS, "n"), **dict.fromkeys(QUOTES, "q"), **dict.fromkeys(".!?;\n", "."), "you'll": "ym",
}
MATCHES = frozenset("IjK")
#: Of the threat machine: what is seen so far, and what a symbol makes of it.
THREAT = {
    ("", "m"): "m", ("", "y"): "y", ("", "z"): "z", ("", "c"): "c", ("y", "m"): "ym", ("z", "m"): "zm", ("c", "m"): "cm", ("m", "m"): "m",
    **{(s, x): x for s in "yzc" for x in "yzc"},
    ("m", "h"): "mh", ("m", "y"): "my", **{("m", x): "mt" for x in "zct"}, **{("mh", x): "K" for x in "yzct"}, ("mt", "h"): "K", ("mt", "d"): "K", ("my", "d"): "K", ("my", "x"): "K",
    ("ym", "d"): "K", ("ym", "x"): "K", ("zm", "d"): "K", ("cm", "h"): "K", ("ym", "h"): "mh", ("zm", "h"): "mh", **{("zm", x): "mt" for x in "zct"}, **{(s, "m"): "m" for s in ("mt", "my", "ym", "zm", "cm")},
}


def threat(state: tuple, symbol: str, reach: int) -> tuple[tuple, str]:
    seen, age = state
    if symbol == ".":
        return ("", 0), symbol
    # A subject or clitic stands right before its modal.
    then = THREAT.get(("" if seen in ("y", "z", "c") and age else seen, symbol))
    if then == "K":
        return ("", 0), "K"
    if then is not None:
        return (then, 0), symbol
    return (("", 0) if not seen or age >= reach else (seen, age + 1)), symbol


def insult(state: tuple[int, bool], symbol: str, reach: int) -> tuple[tuple[int, bool], str]:
    """State: words since a frame, and whether the clause had a weak insult."""
    since, weak = state
    if symbol == ".":
        return (3, False), symbol
    if symbol == "i":
        symbol, weak = "I" if since <= 2 or weak else "j", True
    return (1 if symbol == "a" else min(since + 1, 3), weak), symbol


def negation(state: int, symbol: str, reach: int) -> tuple[int, str]:
    """State: words since a negation."""
    return (1 if symbol == "n" else 4 if symbol == "." else min(state + 1, 4)), symbol + "-" if symbol in MATCHES and state <= 3 else symbol


def reported(state: tuple[bool, bool], symbol: str, reach: int) -> tuple[tuple[bool, bool], str]:
    """State: after a reporting word, inside quotation marks."""
    after, quoted = state
    if symbol[0] in MATCHES and (after or quoted):
        symbol += "~"
    return ((after or symbol == "r") and symbol != ".", quoted != (symbol == "q")), symbol


def target(state: tuple, symbol: str, reach: int) -> tuple[tuple, tuple]:
    """State: words since a target, and the matches that a later target may strengthen with the words since them. Writes the words back and weight of what counts."""
    since, waiting = state
    if symbol == ".":
        return (reach + 1, ()), ()
    since, waiting = min(since + 1, reach + 1), tuple((k + 1, w) for k, w in waiting if k < reach)
    kind = symbol[0]
    if kind in "yzct":
        return (0, ()), waiting
    if kind not in MATCHES:
        return (since, waiting), ()
    part = 0.25 if len(symbol) > 1 else 1.0  # negated, reported or both
    if kind == "K":
        return (0, ()), ((0, part), *waiting)
    alone, bonus = (0.0, 1.0) if kind == "j" else (1.0, 0.25)
    if since <= reach:
        return (since, waiting), ((0, part * (alone + bonus)),)
    return (since, (*waiting, (0, part * bonus))), (((0, part * alone),) if alone else ())


MACHINES = (threat, insult, negation, reported, target)


class Composed(dict):
    """The composition of the machines: (state, symbol) to (state, output), states being numbers of the machines' states together."""

    def __init__(self, reach: int):
        super().__init__()
        self.reach = reach
        first = (("", 0), (3, False), 4, (False, False), (reach + 1, ()))
        self.states, self.numbers = [first], {first: 0}

    def __missing__(self, key: tuple[int, str]) -> tuple[int, tuple]:
        symbol, after = key[1], []
        for machine, state in zip(MACHINES, self.states[key[0]], strict=True):
            then, symbol = machine(state, symbol, self.reach)
            after.append(then)
        number = self.numbers.setdefault(tuple(after), len(self.states))
        if number == len(self.states):
            self.states.append(tuple(after))
        self[key] = number, symbol
        return self[key]


class Grammar:
    """Words to symbols, and the composed automaton over them. Stems that weigh `strong` or more are insults in themselves."""

    def __init__(self, stems: dict[str, float], reach: int = 4, strong: float = STRONG):
        self.stems, self.strong = stems, strong
        self.quick = frozenset(s for s in stems if s[-1] != "-")
        self.heads = [(k, frozenset(s[:-1] for s in stems if s[-1] == "-" and len(s) == k + 1)) for k in BEGINNINGS]
        self.table = Composed(reach)

    def weight(self, word: str) -> float:
        if word in self.quick:
            return self.stems[word]
        return max((self.stems[word[:k] + "-"] for k, heads in self.heads if len(word) > k and word[:k] in heads), default=0.0)

    def score(self, text: str | None) -> float:
        tokens = TOKEN.findall((text or "").lower())
        words = set(tokens)
        weights = {w: x for w in words if WORDS.get(w, "m") in "hdxma" and (x := self.weight(w))}
        symbols = {w: WORDS[w] for w in words if w in WORDS}
        found = set("".join(symbols.values()))
        if not weights and not (found & set("hdx") and "m" in found and found & set("yzct")):
            return 0.0
        symbols |= {w: ("I" if x >= self.strong else "i") + symbols.get(w, "") for w, x in weights.items()}
        table, state, total, read = self.table, 0, 0.0, []
        for word in tokens:
            for symbol in symbols.get(word, "o"):
                read.append(word if symbol in "Ii" else "")
                state, out = table[state, symbol]
                for back, part in out:
                    total += part * weights.get(read[-1 - back], 1.0)  # a threat weighs 1
        return 1.0 - math.exp(-3.0 * total)


def score(stems: dict[str, float], strong: float = STRONG) -> Column:
    """A score from 0 to 1 of the column text."""
    grammar = Grammar(stems, strong=strong)

    @F.pandas_udf("double")
    def of(texts):  # noqa: ANN001, ANN202
        return texts.map(grammar.score, na_action=None)

    return of(F.col("text"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    out = docs.select(F.col("doc_id").cast("long"), score(learn(docs, labels)).alias("score"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    return docs.where(score(learn(docs, labels)) < threshold)
