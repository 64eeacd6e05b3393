"""Broken pairs of prompt and response.

Responses are sorted and each is compared with its neighbour, which shows responses that are the
beginning of others; lengths at which a generator ends conspicuously often show its limit. Where a
response ends without punctuation, its last words are held against the ends of all sentences and
lines of all responses: words after which nobody ends are a break. Then come the rules for copies
and refusals, and a language model, fitted on character trigrams.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import session

#: a word that fewer than this share of all pairs hold is a name, not language
COMMON = 0.002
#: pairs on which the language model is fitted, drawn by a hash of the id
FIT_PAIRS = 8000
#: log odds by which the best language of a prompt and of a response must lead, and words it needs
PROMPT_LEAD, OUTPUT_LEAD, OUTPUT_WORDS = 4.0, 12.0, 6
#: a length limit: so many responses of a generator end at it, so many times the mean of the lengths around
SPIKE_ROWS, SPIKE_TIMES, SPIKE_AROUND = 30, 6.0, 8
#: sentences that begin alike and must be known before their ends alone decide
KNOWN_STARTS = 200
#: responses that are the same single line but for names and numbers, as values and commands are
KNOWN_WHOLE = 5
#: words of a refusal at most; longer responses say more than that
REFUSAL_WORDS = 60

# Responses that stand for none.
PLACEHOLDERS = frozenset(["", "n a", "na", "none", "null", "nil", "nan", "tbd", "todo", "empty", "no answer", "answer", "antwort", "réponse", "reponse", "respuesta", "output", "response", "undefined", "placeholder", "br"])
# Frequent words of each language, which label the pairs the model is fitted on.
SEEDS = {
    "en": "the of and is to in that for with what how which",
    "de": "der die das und ist nicht für wenn wie was ein eine",
    "fr": "le les des et est une dans que pour quand sur du",
    "es": "el los las y es una para que cuando en si del",
}
# Names of languages in the four languages; a prompt that has one asks for another language.
LANGUAGE_NAMES = re.compile(r"\b(english|german|french|spanish|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|anglais\w*|allemand\w*|français\w*|espagnol\w*|inglés\w*|alemán\w*|francés\w*|español\w*|translat\w+|übersetz\w+|tradu\w+)\b")
# How a refusal or a missing answer is put.
REFUSALS = re.compile(
    r"\bi(?: am|'m)? (?:sorry|apologi[sz]e|cannot|can't|can not|could not|won't|will not|must decline|must refuse|have to decline|not able|unable|do not have|don't have|have no)\b"
    r"|\bi(?:'d| would) rather not\b|\bnot something i can\b|\b(?:not|isn't) possible for me\b|\bam (?:not able|unable) to\b|\bmy (?:guidelines|instructions|rules) do not allow\b"
    r"|\bno answer (?:can|is|could)\b|^no answer\b|\bnot enough (?:context|information)\b|\bnot contain enough\b|\bno mention of\b|\bsays nothing about\b|\bis silent on\b"
    r"|\bask someone else about\b|\bas an? (?:ai|language model|assistant)\b|\bbeing an? (?:ai|assistant)\b"
    r"|\b(?:kann|darf|möchte|muss) ich\b.*\b(?:nicht|nichts|ablehnen)\b|\bich (?:kann|darf|muss|möchte)\b.*\b(?:nicht|nichts|ablehnen)\b|\bliegen mir keine\b|\bkeine (?:angaben|auskunft)\b.*\b(?:antwort|möglich)\b|\bwenden sie sich\b.*\bandere\b|\bals sprachmodell\b"
    r"|\bje (?:ne peux|ne suis pas|dois refuser|suis désolée?|regrette)\b|\bne dit rien de\b|\baucune information sur\b|\badressez-vous à une autre\b|\ben tant que modèle\b"
    r"|\b(?:no puedo|debo negarme|lo siento|no dispongo de)\b|\bno es posible dar\b|\btendrá que preguntar\b|\bcomo modelo de\b"
)

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_UNIT = re.compile(r"(?<=[.!?])\s+|\n+")
_ITEM = re.compile(r"^\s*(?:[-*•>]|\d+[.)])\s+")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_COMMAND = re.compile(r"(?m)^\s*[a-z]+ .*(?: --?[a-z]|\$|://| /\w).*(?<![.!?])$")
_ENDED = re.compile(r"(?:[.!?…]|[.!?]?\s*(?:;\)|:\)|\)|```|\]|\}|>))[\"'»“”)*_`]*$")
_CUT = re.compile(r"[,;:(\[{\-–—/=|&\\+$]$")


def masked(text: str, common: frozenset[str]) -> list[str]:
    """Words of a text in lower case; rare words become x and numbers 0."""
    return ["0" if w[0].isdigit() else w if w in common else "x" for w in _TOKEN.findall(text.lower())]


def units(text: str) -> list[str]:
    """Sentences and lines, in order."""
    return [u for u in (_ITEM.sub("", x) for x in _UNIT.split(text.strip())) if u.strip()]


def _end_keys(words: list[str]) -> tuple[str, str, str]:
    last = " ".join(words[-2:])
    return last, f"{words[1]} .. {last}", f"{words[1]} .."


def end_keys(unit: str, common: frozenset[str]) -> tuple[str, str, str] | None:
    """Keys of a unit's end: last two words, these with the first word, the first word."""
    words = masked(unit, common)
    return _end_keys(["^", *words]) if words else None


def copied(instruction: str, output: str) -> bool:
    """Nothing but the instruction: once or more, with at most three words of label before it."""
    if _WORD.findall(output[-80:].lower())[-1:] != _WORD.findall(instruction[-80:].lower())[-1:]:
        return False
    q, o = _WORD.findall(instruction.lower()), _WORD.findall(output.lower())
    for label in range(min(4, len(o))):
        rest = o[label:]
        if q and len(rest) % len(q) == 0 and rest == q * (len(rest) // len(q)):
            return True
    times = len(o) // max(1, len(q))
    return bool(q) and times > 1 and "".join(o).count("".join(q)) == times and len(o) - times * len(q) <= 3 * times and o[-1] == q[-1]


def refused(output: str) -> bool:
    """A short text of which the first sentence, and at least half of all, declines or knows no answer."""
    if re.search(r"\d{2}", output):
        return False
    text = output.lower().replace("’", "'").strip(" \n\t\"'*_>")
    parts = [u for u in units(text) if _WORD.search(u)]
    if not parts or len(_WORD.findall(text)) > REFUSAL_WORDS:
        return False
    hits = [bool(REFUSALS.search(p)) for p in parts]
    return hits[0] and 2 * sum(hits) >= len(parts)


def blank(output: str | None) -> bool:
    text = output or ""
    return not _WORD.search(text) or len(text) < 200 and " ".join(_WORD.findall(text.lower())) in PLACEHOLDERS


class Languages:
    """Naive Bayes over character trigrams of common words."""

    def __init__(self, texts: list[str], common: frozenset[str]):
        seeds = {k: set(v.split()) for k, v in SEEDS.items()}
        self.common, self.memo = common, {}
        grams: dict[str, Counter] = {k: Counter() for k in seeds}
        for text in texts:
            words = self.words(text)
            hits = sorted(((sum(w in s for w in words), k) for k, s in seeds.items()), reverse=True)
            if hits[0][0] >= 2 and hits[0][0] >= 2 * hits[1][0]:
                grams[hits[0][1]].update(g for w in words for g in self.grams(w))
        kinds = len(set().union(*grams.values())) + 1
        self.model = {k: ({g: math.log((n + 0.5) / (c.total() + 0.5 * kinds)) for g, n in c.items()}, math.log(0.5 / (c.total() + 0.5 * kinds))) for k, c in grams.items() if c}

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def words(self, text: str) -> list[str]:
        if "`" in text:
            text = _CODE.sub(" ", text)
        if any(x in text for x in (" -", "$", "://", " /")):
            text = _COMMAND.sub(" ", text)
        return [w for w in _TOKEN.findall(text.lower()) if w in self.common]

    def of(self, text: str, lead: float, least: int = 1) -> str | None:
        """The language that leads clearly, or None."""
        total, words = dict.fromkeys(self.model, 0.0), self.words(text)
        if len(words) < least:
            return None
        for w in words:
            if w not in self.memo:
                self.memo[w] = {k: sum(m.get(g, low) for g in self.grams(w)) for k, (m, low) in self.model.items()}
            for k, v in self.memo[w].items():
                total[k] += v
        best = sorted(total.items(), key=lambda x: -x[1])
        return best[0][0] if len(best) > 1 and best[0][1] - best[1][1] >= lead else None


def whole_key(parts: list[str], common: frozenset[str]) -> str | None:
    """Key of a response that is a single line with a word in it."""
    words = masked(parts[0], common) if len(parts) == 1 else []
    return "= " + " ".join(words) if any(w != "0" for w in words) else None


def _open_end(output: str) -> int:
    """Does the response break off? 1: surely, 0: its last words must tell, -1: no."""
    text = output.rstrip()
    if len(re.findall(r"^\s*```", text, re.M)) % 2:
        return 1
    last = text.rpartition("\n")[2]
    if _CUT.search(text) or last.count("(") > last.count(")") or last.count("“") > last.count("”"):
        return 1
    if re.search(r"(?:^|\s)\S*\d\.$", text):
        return 0
    if len(_TOKEN.findall(text[:80])) <= 3 and re.search(r"\d", text) and "\n" not in text:
        return -1  # a bare value
    return -1 if _ENDED.search(text) else 0


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _shortened(outputs: DataFrame) -> DataFrame:
    """Distinct outputs that another one continues: all are sorted, each is held against the next;
    the last of a sorted part against the first of the next part."""
    parts = max(outputs.sparkSession.sparkContext.defaultParallelism, int(outputs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = outputs.repartitionByRange(parts, "output").sortWithinPartitions("output").withColumn("part", F.spark_partition_id())
    rows = session.stored(rows, "sorted")
    first = rows.groupBy("part").agg(F.min("output").alias("output"))
    edge = first.withColumn("above", F.lead("output").over(Window.orderBy("part"))).select("part", "above")
    nxt = F.lead("output").over(Window.partitionBy("part").orderBy("output"))
    both = rows.withColumn("next", nxt).join(F.broadcast(edge), "part")
    return both.where(F.startswith(F.coalesce("next", "above"), F.col("output"))).select("output")


def defects(pairs: DataFrame) -> DataFrame:
    """(id, defect) of the defective rows of ``pairs`` (id, instruction, output, generator): empty,
    copied_question, refusal, wrong_language or truncated, the first that holds in this order.

    Nulls: rows without id are ignored; a null output is empty; a null instruction is no text, so
    nothing is copied from it and it has no language; null generators are one generator. Repeated
    rows count once; if an id comes with several texts, the first defect in the order above holds.
    Other columns are ignored. Empty tables give no rows. Texts are read whole.

    Scale: the pairs are read for the word counts, the ends of sentences, the sorting and the
    decision; what is shuffled are counts, keys of last words, and the distinct responses once,
    by range. The words kept on the driver are at most (words a pair) / COMMON.
    """
    spark = pairs.sparkSession
    rows = pairs.select(F.col("id").cast("string").alias("id"), F.coalesce("instruction", F.lit("")).alias("instruction"), F.coalesce("output", F.lit("")).alias("output"), F.coalesce("generator", F.lit("")).alias("generator"))
    rows = session.stored(rows.where("id is not null").distinct(), "pairs")

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for i, o in zip(b["instruction"], b["output"]):
                n.update(set(_LETTERS.findall(f"{i}\n{o}".lower())))
            yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    total = rows.count()
    counted = rows.mapInPandas(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = frozenset(r["word"] for r in counted.where(F.col("n") >= max(3.0, COMMON * total)).select("word").collect())
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total))) < FIT_PAIRS).select("instruction", "output").limit(2 * FIT_PAIRS).collect()
    languages = spark.sparkContext.broadcast(Languages([t for r in sample for t in r], common))

    def count_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends, anywhere = Counter(), Counter()
            for o in b["output"]:
                us = units(o)
                for i, u in enumerate(us):
                    words = ["^", *masked(u, languages.value.common)]
                    anywhere.update(zip(words, words[1:]))
                    if len(words) > 1 and (i + 1 < len(us) or _ENDED.search(u)):
                        ends.update(_end_keys(words))
                whole = whole_key(us, languages.value.common)
                if whole:
                    ends[whole] += 1
            met = {" ".join(k): n for k, n in anywhere.items()}
            yield pd.DataFrame([(_key(k), ends[k], met.get(k, 0)) for k in ends.keys() | met.keys()], columns=["key", "ends", "anywhere"])

    outputs = rows.select("output").distinct()
    known = outputs.mapInPandas(count_ends, "key long, ends long, anywhere long").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("anywhere").alias("anywhere"))
    known = session.stored(known, "ends")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for i, q, o, g in zip(b["id"], b["instruction"], b["output"], b["generator"]):
                open_, keys = _open_end(o), None
                rank = 1 if blank(o) else 2 if copied(q, o) else 3 if refused(o) else 0
                if not rank and not LANGUAGE_NAMES.search(q.lower()):
                    mine, other = languages.value.of(q, PROMPT_LEAD), languages.value.of(o, OUTPUT_LEAD, OUTPUT_WORDS)
                    rank = 4 if mine and other and mine != other else 0
                if not rank and open_ == 0:
                    us = units(o)
                    keys = end_keys(us[-1], languages.value.common) if us else None
                    whole = whole_key(us, languages.value.common)
                    keys = keys and (*keys, whole or keys[0])
                got.append((i, g, o, rank, open_, keys is not None, *(map(_key, keys) if keys else (0, 0, 0, 0))))
            yield pd.DataFrame(got, columns=["id", "generator", "output", "rank", "open", "told", *ends_of])

    ends_of = ["k2", "kf", "k1", "kw"]
    judged = rows.mapInPandas(judge, "id string, generator string, output string, rank int, open int, told boolean, k2 long, kf long, k1 long, kw long")
    size = F.length("output")
    lengths = rows.groupBy("generator", size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("generator").orderBy("size").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    spikes = lengths.withColumn("mean", (F.sum("n").over(around) - F.col("n")) / (2 * SPIKE_AROUND))
    spikes = spikes.where((F.col("n") >= SPIKE_ROWS) & (F.col("n") >= SPIKE_TIMES * F.col("mean")) & (F.col("size") >= 200)).select("generator", "size", F.lit(True).alias("spike"))
    short = _shortened(outputs.where(F.length("output") >= 15)).withColumn("short", F.lit(True))
    out = judged.withColumn("size", size).join(spikes, ["generator", "size"], "left").join(short, "output", "left").drop("output")
    for k in ends_of:
        out = out.join(known.select(F.col("key").alias(k), F.col("ends").alias(f"{k}_ends"), F.col("anywhere").alias(f"{k}_any")), k, "left")

    def n(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    never = (n("k2_ends") == 0) | (n("k2_ends") < 0.02 * n("k2_any"))
    unlike = (n("k1_ends") >= KNOWN_STARTS) & (n("kf_ends") == 0)
    cut = (F.col("open") == 1) | ((F.col("open") == 0) & F.col("told") & (n("kw_ends") < KNOWN_WHOLE) & (never | unlike | F.col("spike").isNotNull() | (F.col("short").isNotNull() & (n("k2_ends") < 0.2 * n("k2_any")))))
    rank = F.when(F.col("rank") > 0, F.col("rank")).when(cut, 5)
    names = F.element_at(F.array(*[F.lit(x) for x in ("empty", "copied_question", "refusal", "wrong_language", "truncated")]), F.col("rank"))
    return out.select("id", rank.alias("rank")).where("rank is not null").groupBy("id").agg(F.min("rank").alias("rank")).select("id", names.alias("defect"))
