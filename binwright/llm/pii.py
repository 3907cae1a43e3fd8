"""Personal data: contract patterns as seeds, and identifiers found by the contexts that seeds occur in.

1. One scan finds the *base* spans (four kinds), *failed* ones (base shape, but wrong digits) and *open* ones
   (looser shapes of the same kinds, not overlapping a base span), each with its lexical contexts: the one
   and the two words before it and the word after it.
2. Spark scores the graph of patterns (kind and context) and instances (kind and normalised text), a few rounds:
   a pattern's confidence is the mean confidence of its distinct instances, where seeds count 1, failed ones 0
   and open ones what they have so far, and it must hold ``MIN_SEEDS`` different seeds; an open instance has the
   noisy-or of its patterns.
3. Open instances above ``ACCEPT`` become spans. Base spans always stay.

Matches are leftmost and non-overlapping per kind. Runs are found first and cut afterwards, so that no pattern
backtracks over a long run.

Defined cases: null text is empty; such rows have zero counts, no spans and the digest of the empty string.
Rows that repeat a doc_id keep their own spans (rows are told apart by id and text). A null doc_id stays
null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.llm.common import id_and_text, ship, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 3
ACCEPT = 0.8

# Fixed patterns of the contract.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser shapes of the same kinds. Every repeat is bounded.
OPEN = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/])"),
    "phone": re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-])"),
}
WORD_BEFORE = re.compile(r"(\S{1,40})\s+(?:(\S{1,40})\s*)?$")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """An address starts where the run of local characters before its @ starts, or the match before it ends."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = DOMAIN.match(text, at)
        if host:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, host.end(), True
                done = host.end()
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Of each dotted run of numbers, the first four, the next four, and so on."""
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + len(four) - 1
            if len(four) == 4:
                yield at, end, all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four)
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PHONE.finditer(text):
        yield m.start(), m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base, failed and open spans (kind, start, end), each by kind and start."""
    base, failed = [], []
    for kind, finder in FINDERS.items():
        for start, end, good in finder(text):
            (base if good else failed).append((kind, start, end))
    taken = sorted((s, e) for _, s, e in base)
    loose = []
    for kind, shape in OPEN.items():
        for m in shape.finditer(text):
            if not _overlaps(taken, m.start(), m.end()) and _sound(kind, m[0]):
                loose.append((kind, m.start(), m.end()))
                taken = sorted([*taken, (m.start(), m.end())])
    return base, failed, loose


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in taken)


def _sound(kind: str, found: str) -> bool:
    """Open shapes keep the digit rules of their kind."""
    numbers = re.findall("[0-9]+", found)
    return {"ip": lambda: all(int(n) <= 255 for n in numbers), "card": lambda: luhn("".join(numbers))}.get(kind, lambda: True)()


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: one and two words before, one word after."""
    words = text[max(0, start - 90) : start].split()[-2:]
    after = text[end : end + 45].split()[:1]
    shape = lambda w: re.sub("[0-9]+", "0", w.lower())[:40]
    out = [f"<{shape(words[-1])}"] if words else []
    out += [f"<{shape(words[0])} {shape(words[1])}"] if len(words) == 2 else []
    return out + [f">{shape(after[0])}" for _ in after[:1]]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = (
    "doc_id long, row_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "edges array<struct<kind:string, start:bigint, end:bigint, status:string, instance:string, patterns:array<string>>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Per row its base spans, and the edges of all its instances to their patterns."""
    ship(docs.sparkSession)
    edge = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("status", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, failed, loose = find(text)
                edges = [
                    {
                        "kind": k, "start": s, "end": e, "status": status, "patterns": contexts(text, s, e),
                        "instance": hashlib.sha256(re.sub(r"[\s().-]", "", text[s:e].lower()).encode("utf-8", "surrogatepass")).hexdigest()[:24],
                    }
                    for status, spans in (("seed", base), ("failed", failed), ("open", loose))
                    for k, s, e in spans
                    # a failed run of few digits is not evidence against a context
                    if status != "failed" or e - s >= 9
                ]
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base), edges))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(edge)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "row_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "edges"],
            )

    rows = id_and_text(docs).withColumn("row_key", F.xxhash64("text"))
    return rows.mapInArrow(run, FOUND)


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Accepted open spans: doc_id, row_key, kind, start, end, confidence."""
    edges = found.select("doc_id", "row_key", F.explode("edges").alias("e")).select("doc_id", "row_key", "e.*")
    links = (
        edges.select("kind", "instance", "status", F.explode("patterns").alias("pattern"))
        .groupBy("kind", "pattern", "instance")
        .agg(F.max(F.col("status") == "seed").alias("seed"), F.min(F.col("status") == "open").alias("open"))
    )
    links = stored(links, "pattern_links")
    # Only patterns that an open instance has can matter.
    links = links.join(links.where("open").select("kind", "pattern").distinct(), ["kind", "pattern"], "left_semi")
    scores = None
    for _ in range(rounds):
        weighed = links.withColumn("weight", F.when(F.col("seed"), 1.0).otherwise(0.0))
        if scores is not None:
            weighed = weighed.join(scores, ["kind", "instance"], "left").withColumn(
                "weight", F.when(F.col("open"), F.coalesce("score", "weight")).otherwise(F.col("weight"))
            )
        patterns = weighed.groupBy("kind", "pattern").agg(
            F.avg("weight").alias("confidence"), F.count(F.when(F.col("seed"), 1)).alias("seeds")
        )
        good = patterns.where(F.col("seeds") >= MIN_SEEDS).select("kind", "pattern", F.least("confidence", F.lit(0.99)).alias("confidence"))
        scores = stored(
            links.where("open").join(good, ["kind", "pattern"]).groupBy("kind", "instance")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")),
            "instance_scores",
        )
    accepted = edges.where("status = 'open'").join(scores.where(F.col("score") >= ACCEPT), ["kind", "instance"])
    return accepted.select("doc_id", "row_key", "kind", "start", "end", F.col("score").alias("confidence"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and discovered), n_discovered."""
    found = stored(scan(docs), "personal_data")
    more = discover(found).select(
        "doc_id", "row_key", F.struct(_rank("kind").alias("rank"), F.col("start"), F.col("end"), F.col("kind")).alias("span")
    ).distinct()
    more = more.groupBy("doc_id", "row_key").agg(F.collect_list("span").alias("more"))
    rows = found.drop("edges").alias("a").join(
        more.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_key") == F.col("b.row_key")), "left"
    ).select("a.*", F.coalesce("b.more", F.array().cast("array<struct<rank:int, start:bigint, end:bigint, kind:string>>")).alias("more"))
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(
            _rank(F.split(x, ":")[0]).alias("rank"), F.split(x, ":")[1].cast("long").alias("start"),
            F.split(x, ":")[2].cast("long").alias("end"), F.split(x, ":")[0].alias("kind"),
        ),
    )
    every = F.array_sort(F.concat(base, "more"))
    spans = F.when(F.size("more") == 0, F.col("base")).otherwise(
        F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    )
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size("more").cast("long").alias("n_discovered"))


def _rank(kind):
    column = F.col(kind) if isinstance(kind, str) else kind
    return F.array_position(F.array(*map(F.lit, KINDS)), column).cast("int")
