"""Personal data: base patterns, and identifiers bootstrapped from context.

The base patterns (email, ip, card, phone) give seed entities. Every
identifier-like token is an instance, the words beside it are its lexical patterns,
and the two form a bipartite graph over the whole corpus. Spark scores the graph
iteratively: a pattern is trusted by the share of its distinct instances that are
known, an instance by the patterns it occurs in. Instances under trusted patterns
that no base pattern matches are reported with kind ``id``; base spans stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table
from counterpanel.llm.memory import handing_back

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
TRUST = 0.7  # confidence that a pattern, and score that an instance needs
SEEDS = 3  # distinct known instances that a pattern needs
SMOOTH = 0.5
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s\"'`<>()\[\]{},;=|]{6,}+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_MARK = re.compile(r"\w+|[^\w\s]")
_ZERO = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; at each @ the local part is the run before it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > end and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            yield lo, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _words_beside(text: str, at: int, side: int) -> list[str]:
    """The two words or marks next to ``at`` on its line, digits as 0; left (-1)
    of it or right (1), nearest last or first. Fewer where the line ends."""
    if side < 0:
        edge = text.rfind("\n", 0, at) + 1
    else:
        edge = text.find("\n", at)
        edge = edge if edge >= 0 else len(text)
    reach = 48
    while True:
        beside = text[max(edge, at - reach) : at] if side < 0 else text[at : min(edge, at + reach)]
        words = _MARK.findall(beside.lower())
        if len(words) >= 2 or reach >= abs(at - edge):
            words = words[-2:] if side < 0 else words[:2]
            return [_ZERO.sub("0", w) for w in words]
        reach *= 4


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Two words to the left and two to the right, as far as the line goes; ^ and $
    stand for words beyond it. A side without words is no pattern, since a line's
    start or end alone tells little, unless the token is alone on its line."""
    left, right = _words_beside(text, start, -1), _words_beside(text, end, 1)
    out = ["< " + " ".join(["^", "^", *left][-2:])] if left or not right else []
    return [*out, "> " + " ".join([*right, "$"][:2])] if right else out


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, list[str]]]:
    """(kind, start, end, value, patterns): base entities and, with kind id, other
    tokens of 6 characters or more that hold a digit and touch no base span."""
    out = [(kind, a, b, text[a:b].lower(), _patterns(text, a, b)) for kind, a, b in base]
    if _ANY.search(text):
        taken = sorted((a, b) for _, a, b in base)
        i = 0
        for t in _TOKEN.finditer(text):
            a, b = t.span()
            if not _ANY.search(text, a, b):
                continue
            while text[b - 1] in ".:!?*$%&#" and b - a > 6:
                b -= 1
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if not any(x < b and a < y for x, y in taken[i : i + 8]):
                out.append(("id", a, b, text[a:b].lower(), _patterns(text, a, b)))
    return out


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, value) of found instances from distinct (pattern, value, seed).

    Each round, pattern confidence = sum of its instances' scores / (their number
    + SMOOTH), 0 below SEEDS known instances; instance score = 1 for seeds, else
    1 - product of (1 - confidence) over its patterns. Both are sums over edges,
    so a frequent pattern is aggregated before it is shuffled.
    """
    scores = edges.select("pattern", "value", F.col("seed").cast("double").alias("score"), "seed")
    confidence = None
    for _ in range(rounds):
        confidence = (
            scores.groupBy("pattern")
            .agg(F.sum("score").alias("known"), F.count("*").alias("n"))
            .select("pattern", F.when(F.col("known") >= SEEDS, F.col("known") / (F.col("n") + SMOOTH)).otherwise(0.0).alias("confidence"))
        )
        valued = edges.join(confidence, "pattern")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        by_value = valued.groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score"))
        scores = written_table(edges.join(by_value, "value").select("pattern", "value", "score", "seed"), "pii-scores")
    return (
        scores.join(confidence, "pattern").filter((F.col("confidence") >= TRUST) & (F.col("score") >= TRUST) & ~F.col("seed"))
        .select("pattern", "value").distinct()
    )


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    n_id (added spans), spans (base and added).

    Counts are of base matches. A null text is empty (no spans, the hash of an
    empty string). Repeated rows stay as rows; a pattern's instances are counted
    by distinct value, so copies add no trust. Words on the token's line, on both
    sides, are its context. Other columns are not read.
    """
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    kind = given.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"]
    found_type = pa.list_(
        pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                body = t.as_py()
                base = base_spans(body)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS] if base else [0] * 4
                joined = span_text(base)
                found = [dict(zip(("kind", "a", "b", "value", "patterns"), x, strict=True)) for x in instances(body, base)]
                rows.append((*counts, hashlib.sha256(joined.encode()).hexdigest(), joined, found))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), found_type]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names
            )

    schema = (
        f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, "
        "found array<struct<kind:string,a:bigint,b:bigint,value:string,patterns:array<string>>>"
    )
    scanned = written_table(given.mapInArrow(handing_back(scan), schema).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    seen = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    seen = seen.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = written_table(
        seen.groupBy("pattern", "value").agg(F.max(F.col("kind") != "id").alias("seed")), "pii-edges"
    )
    added = (
        seen.filter("kind = 'id'").join(trusted_patterns(edges, rounds), ["pattern", "value"])
        .groupBy("row").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("added"))
    )
    extra = F.array_join(F.transform("added", lambda s: F.concat(F.lit("id:"), s.a.cast("string"), F.lit(":"), s.b.cast("string"))), ",")
    return scanned.drop("found").join(added, "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("added").isNull(), F.lit(0)).otherwise(F.size("added")).cast("bigint").alias("n_id"),
        F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), extra).alias("spans"),
    )
