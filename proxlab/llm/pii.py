"""Personal data by bootstrapped contextual extraction (operator 4).

Seeds: e-mail addresses, IPv4 addresses, payment-card numbers (Luhn) and telephone numbers of strict form.
Bootstrapping: the words to the left of an entity are its lexical patterns (one word and two words, in
lower case, digits as 0).  Strings of looser form (a telephone number without a plus, a card number with a
misread digit, an address written "name at host dot org") are candidates; so the pattern-instance graph has
an edge wherever a pattern precedes a seed or a candidate.  Spark scores it iteratively: an instance's
confidence is 1 for seeds and otherwise 1 - product(1 - confidence of its patterns); a pattern's confidence for a kind is the
mean confidence, as that kind, of its distinct instances scored so far, where seeds of other kinds count as 0 and candidates
not yet scored do not count, and it is 0 under ``min_seeds`` distinct seeds.  After ``rounds``
rounds, candidates that follow a pattern of at least ``min_confidence`` are found.  Seeds always stay; what is
found never overlaps them, and of overlapping finds the earlier, then longer one stays.

Nothing about the corpus reaches the driver: patterns, instances and finds are joined by key.  Texts are read
once; the spans and candidates of each document are written to the shared folder.

Matching is leftmost and non-overlapping per kind; a match that fails its check (digit count, Luhn, parts
over 255) is dropped without a second try.  All scans are linear in the text.  Offsets are code points, ends
exclusive.  A null text is empty; documents are told apart by id and text, so repeated rows get equal
results; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, prepare, saved

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_CONFIDENCE, MIN_SEEDS = 3, 0.8, 5

# fixed values: the base forms of the contract
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGITS = re.compile(r"[^0-9]+")

# looser forms, found only in context
LOOSE = {
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9]{1,5}(?:\.[0-9]{1,5}){3,5}|[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7})(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,14}(?![0-9A-Za-z])"),
}
LOOSE_AT = re.compile(r"@| ?\(at\) ?| ?\[at\] ?| at ", re.IGNORECASE)
LOOSE_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{1,63})*", re.IGNORECASE)
LEFT_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, driven by the @ signs: a name is the run of name characters before one."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        name = text[floor:at]
        start = floor + len(name.rstrip(EMAIL_NAME))
        m = EMAIL_HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the strict forms, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    # a part is at most 255 if, without leading zeros, it has at most three digits and is
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:  # 19 digits and as many separators less one
            digits = NO_DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NO_DIGITS.sub("", m.group())) <= 15]
    return out


def normal(text: str) -> str:
    return re.sub(r"[0-9]", "0", text.lower())


def left_patterns(text: str, start: int) -> list[str]:
    """The one and the two words before ``start`` (within 80 characters, which bounds a pattern)."""
    words = LEFT_WORD.findall(text, max(0, start - 80), start)
    return [f"{k}:{normal(' '.join(words[-k:]))}" for k in (1, 2) if len(words) >= k]


def loose_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with spelled-out signs, or with a host of one part; a spelled-out sign needs a dot in the host."""
    out, floor, after = [], 0, 0
    for m in LOOSE_AT.finditer(text):
        before, after = after, m.end()  # no name reaches over an earlier sign
        if m.start() <= floor:
            continue
        name = text[max(floor, before):m.start()]
        start = m.start() - (len(name) - len(name.rstrip(EMAIL_NAME)))
        host = LOOSE_HOST.match(text, m.end()) if start < m.start() else None
        if host and (m.group() == "@" or re.search(r"\.|dot", host.group(), re.IGNORECASE)):
            out.append((start, host.end()))
            floor = host.end()
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose forms that overlap no base span."""
    busy = sorted((a, b) for _, a, b in taken)
    out = []
    for kind, name in enumerate(KINDS):
        spans = loose_emails(text) if name == "email" else (m.span() for m in LOOSE[name].finditer(text))
        i = 0
        for a, b in spans:
            while i < len(busy) and busy[i][1] <= a:
                i += 1
            if i == len(busy) or busy[i][0] >= b:
                out.append((kind, a, b))
    return out


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
MENTION = T.StructType([*SPAN.fields, T.StructField("instance", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
ARROW_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
ARROW_MENTION = pa.list_(pa.struct([*ARROW_SPAN, pa.field("instance", pa.string()), pa.field("patterns", pa.list_(pa.string()))]))
INTERESTING = re.compile(r"[0-9@]|[ (\[]at[ )\]]", re.IGNORECASE)


def mentions(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """[k, row, seeds, others]: strict spans and loose candidates of each document, with their patterns."""
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key).cast("string"), F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["k"], T.StructField("row", T.LongType()), T.StructField("seeds", T.ArrayType(MENTION)), T.StructField("others", T.ArrayType(MENTION))])

    def described(text, spans):
        return [{"kind": k, "start": a, "end": b, "instance": normal_instance(text[a:b]), "patterns": left_patterns(text, a)} for k, a, b in spans]

    def run(batches):
        for batch in batches:
            seeds, others = [], []
            for t in column_array(batch, "text"):
                text = t.as_py() or ""
                if not INTERESTING.search(text):
                    seeds.append([])
                    others.append([])
                    continue
                base = base_spans(text)
                seeds.append(described(text, base))
                others.append(described(text, candidates(text, base)))
            yield pa.RecordBatch.from_arrays([column_array(batch, "k"), column_array(batch, "row"), pa.array(seeds, ARROW_MENTION), pa.array(others, ARROW_MENTION)], names=schema.names)

    return rows.mapInArrow(run, schema)


def normal_instance(text: str) -> str:
    return re.sub(r"[\s().-]+", "", text.lower())


def trusted_patterns(found: DataFrame, rounds: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """[pattern, kind] of high confidence, by iterative scoring of the pattern-instance graph."""
    flat = lambda col, seed: (found.select(F.explode(col).alias("m"))
                              .select(F.explode("m.patterns").alias("pattern"), F.col("m.kind").alias("kind"), F.col("m.instance").alias("instance"), F.lit(seed).alias("seed")))
    edges = (flat("seeds", 1).unionAll(flat("others", 0)).groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")))
    # a pattern without enough seeds of a kind never gains confidence in it
    strong = edges.groupBy("pattern", "kind").agg(F.sum("seed").alias("seeds"))
    whole = strong.groupBy("pattern").agg(F.sum("seeds").alias("all_seeds"))
    able = strong.where(F.col("seeds") >= min_seeds).join(whole, "pattern").select("pattern", "kind", (F.col("all_seeds") - F.col("seeds")).alias("against"))
    edges = saved(edges.join(able, ["pattern", "kind"]), "pattern-instances")
    scored = edges.withColumn("belief", F.when(F.col("seed") == 1, F.lit(1.0)))
    for i in range(rounds):
        # sums and counts leave out candidates without a belief
        patterns = scored.groupBy("pattern", "kind").agg((F.sum("belief") / (F.count("belief") + F.max("against"))).alias("confidence"))
        if i == rounds - 1:
            return patterns.where(F.col("confidence") >= min_confidence).select("pattern", "kind")
        told = edges.where("seed = 0").join(patterns, ["pattern", "kind"]).groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("told"))
        scored = edges.join(told, ["kind", "instance"], "left").withColumn("belief", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.col("told")))
    return edges.select("pattern", "kind").limit(0)


def apart(spans):
    """Of overlapping spans (sorted by start, longer first) the earlier stays."""
    empty = F.array().cast(T.ArrayType(SPAN))
    return F.aggregate(spans, empty, lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))


def extract(docs: DataFrame, key: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE,
            min_seeds: int = MIN_SEEDS) -> DataFrame:
    """[key, base, found]: arrays of (kind number, start, end) by kind, then start; kinds are numbered as in ``KINDS``."""
    prepare(docs)
    all_rows = saved(mentions(docs, key, text_col), "mentions")
    trusted = trusted_patterns(all_rows, rounds, min_confidence, min_seeds)
    hits = (all_rows.where("size(others) > 0").select("row", F.explode("others").alias("m"))
            .select("row", "m.kind", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
            .join(trusted, ["pattern", "kind"], "left_semi").select("row", F.struct("start", (-F.col("end")).alias("less"), "kind").alias("s")).distinct()
            .groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s"))
            .select("row", apart(F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["less"]).alias("end")))).alias("found")))
    plain = lambda c: F.transform(c, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    out = all_rows.join(hits, "row", "left")
    return out.select(F.col("k").alias(key), F.sort_array(plain("seeds")).alias("base"), F.sort_array(F.coalesce("found", F.array().cast(T.ArrayType(SPAN)))).alias("found"))


def as_text(spans):
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
