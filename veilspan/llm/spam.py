"""Problem 9: keyword-stuffed and link-list pages.

Content and link features of a page (which shares of its characters are sentences, keywords, links, product tags or
technical lines, how often its word pairs repeat, and so on) go into bagged decision trees. They are trained on weak
labels: pages whose shares leave no doubt. Predictions are then smoothed by the spam rate of the page's host.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.batches import sliced
from veilspan.llm.trees import Bag
from veilspan.sources.shared import shared_folder
from veilspan.sources.tables import table

SAMPLE = 4000  # labelled pages the trees are fitted on, at most
HOST_PAGES = 10.0  # pages that the overall rate counts for in a host's rate
HOST_WEIGHT = 0.25
SALTS = 16

# Function words of French, English and German, and words of shop and search phrases.
FUNCTION = frozenset(
    "le la les l un une des du de d au aux et ou mais donc or ni car que qui dont où ce cet cette ces son sa ses leur leurs se s sur sous dans par pour avec sans selon entre vers devant derrière après avant depuis malgré contre chez en y à est sont était quand on il elle ils elles nous vous je tu ne pas plus n qu c j m t "
    "the a an one two of in on at by for with from to and but under over above below behind beyond around across inside outside towards during before after despite against into within without through is are was were be it this that these those he she they we you i not no his her their its our your as or near "
    "der die das den dem des ein eine einen einem einer und oder aber durch für gegen ohne um an auf hinter neben unter über vor zwischen mit nach bei seit von zu aus ist sind war im am zum zur nicht kein sich es er sie wir ihr ich".split()
)
SHOP = frozenset(
    "prix pas cher chère avis meilleur meilleure meilleurs livraison promo promotion devis gratuit gratuite comparatif achat acheter achetez comparez ligne stock sku 24h soldes offre "
    "price cheap best review reviews buy deal deals free near me top online shop sale discount order delivery shipping coupon compare "
    "preis günstig angebot vergleich kaufen kostenlos bester test online bestellen rabatt lieferung".split()
)
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w@./])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/[^\s<>\"')\]]*")
_ANCHOR = re.compile(r"<a\s[^>]*>|</a>|&raquo;|&gt;")
_HASHTAG = re.compile(r"(?<!\w)#\w+")
_PRICE = re.compile(r"\d+[.,]\d{2} ?[€$£]|[€$£] ?\d+|★|☆|\bSKU\b|\b-\d+ ?%|-\d{1,2} %")
_TECHNICAL = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d|[\[{}\]<]|[-drwx]{10}\s|#!|import |def |return |class |\$ |\+ |@@|commit [0-9a-f]|[\w.\-]+/[\w./\-]+(?::|$))|[=;{}]\s*$|\w=\S|\"\s*:|^\s*[\w.-]+:\s*\S*\s*$|^\s*</?\w+[^>]*>.*</\w+>\s*$|\S@\S+\s*[|;,\t]|\bdef \w+\(|^\s*(?:SELECT|INSERT|CREATE|UPDATE|export|git|curl|make|set) ")
_SENTENCES = re.compile(r"(?<=[.!?…])[\"»”)]*\s+")

NAMES = ("sentence", "keyword", "link", "tag", "technical", "stuffed", "function", "shop", "repeats", "distinct", "links", "hashtags", "separators", "prices", "digits", "line", "size", "filler")
_SHOP_PHRASES = re.compile(r"\b(?:pas cher|en ligne|near me)\b")
_COUNTS = re.compile(r"\(\d+\)")
_ROW = re.compile(r"[;|\t]")
_NO_DIGITS = {ord(c): None for c in "0123456789"}


def _kind(line: str, found: list[str]) -> str:
    """``sentence``, ``keyword``, ``link``, ``tag`` or ``technical`` for a line or sentence; its words go to ``found``."""
    links = "/" in line and ("://" in line or "<a " in line or _URL.search(line) is not None)
    low = line.lower()
    bare = _ANCHOR.sub(" ", _URL.sub(" ", low)) if links else low
    words = _WORDS.findall(bare)
    found += words
    if " cher" in low or " ligne" in low or " me" in low:
        bare = _SHOP_PHRASES.sub(" ", bare)
        words = _WORDS.findall(bare)
    n = len(words)
    helpers = sum(map(FUNCTION.__contains__, words))
    if links and (n < 5 or helpers < 2 or helpers < 0.15 * n or len(bare) < 0.35 * len(line)):
        return "technical" if "](" not in line and "<a " not in line and _TECHNICAL.search(bare) else "link"
    if line.count("#") > 2 and len(_HASHTAG.findall(line)) * 2 >= n - sum(map(str.isdigit, words)):
        return "tag"
    if helpers <= 2 and helpers < 0.2 * max(n, 1) and _PRICE.search(line):
        return "tag"
    if n >= 4 and helpers >= 2 and helpers >= 0.15 * n:
        return "sentence"
    if _TECHNICAL.search(line):
        return "technical"
    counts = _COUNTS.findall(line) if "(" in line else ()
    digits = sum(map(str.isdigit, words)) - len(counts)
    if n - len(counts) < 1 or digits > 0.3 * n or (digits > 0.12 * n or "@" in line) and len(_ROW.findall(line)) >= 3 and "★" not in line:
        return "technical"
    return "keyword" if helpers < 0.15 * n or n < 4 else "sentence"


def features(text: str) -> list[float]:
    """The features named in ``NAMES``."""
    shares = dict.fromkeys(NAMES[:5], 0)
    words: list[str] = []
    lines = total = 0
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        lines += 1
        for part in _SENTENCES.split(line) if len(line) > 120 else (line,):
            total += len(part)
            shares[_kind(part, words)] += len(part)
    total, lines = max(total, 1), max(lines, 1)
    n = max(len(words), 1)
    content = [w for w in words if w not in FUNCTION]
    size = max(len(content), 1)
    pairs = Counter(zip(content, content[1:], strict=False)).values()
    # words, or pairs of them, that come again and again, over all content words: high where sentences are stuffed
    heavy = sum(c for c in Counter(content).values() if c >= 6 and c > 0.2 * size)
    stuffed = min(1.0, max(2 * sum(c for c in pairs if c >= 4), 1.5 * heavy) / size)
    filler = (shares["keyword"] + shares["link"] + shares["tag"] + (shares["sentence"] * stuffed if stuffed > 0.5 else 0)) / total
    links = text.count("://") + text.count("<a ") + (len(_URL.findall(text)) if shares["link"] else 0)
    return [
        *(shares[k] / total for k in NAMES[:5]), stuffed, (n - len(content)) / n, sum(map(SHOP.__contains__, content)) / size, sum(c for c in pairs if c >= 3) / size,
        len(set(content)) / size, links / n, text.count("#") / n, (sum(map(text.count, "·|/,>•;»–~+")) + text.count(" - ")) / n,
        (len(_PRICE.findall(text)) if shares["tag"] else 0) / lines, 1 - len(text.translate(_NO_DIGITS)) / max(len(text), 1), math.log1p(total / lines), math.log1p(total), filler,
    ]


def weak_label(f: list[float] | np.ndarray) -> int | None:
    """1 for a page that is surely spam, 0 for one that surely is not, else null."""
    x = dict(zip(NAMES, f, strict=True))
    bad = x["keyword"] + x["link"] + x["tag"]
    if x["technical"] > 0.4:
        return 0
    if bad > 0.6 and (x["shop"] > 0.08 or x["links"] > 0.04 or x["hashtags"] > 0.2 or x["prices"] > 0.4 or x["separators"] > 0.2 or x["repeats"] > 0.3):
        return 1
    if x["stuffed"] > 0.5 and (x["repeats"] > 0.25 or x["filler"] > 0.7):
        return 1
    if bad < 0.4 and x["stuffed"] < 0.4 and x["repeats"] < 0.25:
        return 0
    return None


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        x = [features(t) for t in batch.column("t").to_pylist()]
        yield pa.record_batch([batch.column("k"), pa.array([weak_label(f) for f in x], pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["k", "label", "x"])


def fitted(documents: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Bag:
    """Trees on the weakly labelled of about ``sample`` pages (all, if there are fewer), chosen by a hash of their keys.

    Features are made where the pages are; the driver gets their numbers and labels only.
    """
    rows = documents.where(F.col(key).isNotNull() & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    share = min(1.0, sample / max(1, documents.where(F.col(key).isNotNull()).count()))
    chosen = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = sorted((r["k"], r["x"], r["label"]) for r in chosen.mapInArrow(_vectors, "k string, label int, x array<double>").where("label is not null").collect())  # about ``sample`` rows of numbers
    return Bag(np.array([x for _, x, _ in known]).reshape(-1, len(NAMES)), np.array([v for _, _, v in known], dtype=float))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))
    return F.log(q / (1 - q))


def scored(documents: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """``key``, ``page`` (the trees' score), ``host_rate`` and ``score`` (page score smoothed by the host's rate).

    Null, empty and blank texts score 0; very long ones are read whole; a score of exactly one half is no spam. A null host smooths nothing. Null keys are left out. Repeated rows are
    scored row by row, and count so in their host's rate. An empty table gives no rows. Other columns are ignored.
    """
    bag = fitted(documents, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("__text").to_pylist()
            there = [i for i, t in enumerate(texts) if t and not t.isspace()]
            page = np.zeros(len(texts))
            if there:
                page[there] = bag.predict(np.array([features(texts[i]) for i in there]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(page)], names=[key, "host", "page"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("__text"))
    shared_folder(documents.sparkSession)
    pages = rows.mapInArrow(run, f"`{key}` {kind}, host string, page double").checkpoint()  # keys, hosts and scores only
    overall = F.lit(pages.agg(F.avg("page")).first()[0] or 0.0)
    rates = pages.where("host is not null").groupBy("host").agg(((F.sum("page") + HOST_PAGES * overall) / (F.count("*") + HOST_PAGES)).alias("host_rate"))
    # the pages of one host may be a third of all: they are salted, and its rate is copied to every salt
    rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = pages.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(rates, ["host", "salt"], "left")
    moved = _logit(F.col("page")) + HOST_WEIGHT * (_logit(F.col("host_rate")) - _logit(overall))
    return out.select(key, "page", "host_rate", F.when(F.col("page") == 0, 0.0).when(F.col("host_rate").isNull(), F.col("page")).otherwise(1 / (1 + F.exp(-moved))).alias("score"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents made of keywords, links or product tags."""
    documents = table(spark, directory, "documents", "doc_id", "text", "origin")
    return scored(documents, "doc_id", "text", "origin").where("score > 0.5").select("doc_id")


QUERIES = {"p9_found": p9_found}
