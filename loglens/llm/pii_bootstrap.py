"""Personal data by fixed rules, widened by bootstrapped contextual extraction.

Base rules find emails, IP addresses, card numbers (Luhn) and phone numbers.  They seed a search
for identifiers the rules miss: every base span and every other identifier-like token (digits or an
at sign) becomes a mention with its lexical contexts (two words before; one before and one after; two
after).  Mentions of one surface form are an instance, contexts are patterns, and Spark scores the
graph between them in rounds: a pattern is as good for a kind as the share of its instances
that are of that kind, and an unknown instance is as good as its patterns together say.  Patterns need
the support of several different instances, so that copies of a text prove nothing, and all their
instances count against them, so that everyday words are no patterns.  Instances over the threshold add
spans of their kind; base spans always stay.

One Arrow pass reads the texts; the graph is built from mentions alone, as distinct (pattern,
instance) edges, which a map-side step shrinks.  Nothing but the found spans is joined back to the rows.

Defined results: a null or empty text has no spans; starts and ends are code points of the whole text; a match
that fails its check is dropped without a second try; null and repeated ids are kept, each row on
its own; columns that clash with names used here are safe, as the input row travels in one struct.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut, join_checked, map_arrow, row_with_text, texts

#: Kinds in their fixed order.
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs this many different instances of the kind, and this share of all its instances.
LEAST_SUPPORT = 4
LEAST_SHARE = 0.6
#: Added to a pattern's instances when its share is taken.
DOUBT = 1.0
#: An unknown instance needs this score.
LEAST_SCORE = 0.8
#: Contexts are read within so many characters.
REACH = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]\S*")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|=~/\\-_+"
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign: the run of name characters before it starts the match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start."""
    return [(k, a, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]


def unknown_tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that touch no base span: three digits or an at sign, four characters."""
    out, last = [], 0
    taken = sorted((a, b) for _, a, b in spans)
    i = 0
    for m in _MARKED.finditer(text):
        start, end = m.span()
        while start > last and not text[start - 1].isspace():
            start -= 1
        last = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        token = text[start:end]
        if len(token) < 4 or ("@" not in token and sum(map(str.isdigit, token)) < 3):
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if not any(a < end and b > start for a, b in taken[i:i + 4]):
            out.append((start, end))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span."""
    left = text[max(0, start - REACH):start].lower().split()[-2:]
    right = text[end:end + REACH].lower().split()[:2]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2:
        out.append(f"_ {right[0]} {right[1]}")
    return out


def _find_batches(batches):
    import pyarrow as pa

    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    mention = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for batch in batches:
        found, mentions = [], []
        for value in texts(batch):
            text = value.as_py() or ""
            spans = base_spans(text)
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            rest = [(None, a, b) for a, b in unknown_tokens(text, spans)]
            mentions.append([{"kind": k, "start": a, "end": b, "patterns": contexts(text, a, b),
                              "instance": hashlib.blake2b(text[a:b].lower().encode(), digest_size=12).hexdigest()}
                             for k, a, b in [*spans, *rest]])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, span), pa.array(mentions, mention)],
                                         ["row", "base", "mentions"])


def found_base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A written table: a row number, the kept columns, base spans and mentions."""
    rows = docs.select(*row_with_text(docs, keep))
    schema = (f"row {rows.schema['row'].dataType.simpleString()}, base array<struct<kind:int,start:bigint,end:bigint>>, "
              "mentions array<struct<kind:int,start:bigint,end:bigint,instance:string,patterns:array<string>>>")
    out = map_arrow(rows, _find_batches, schema)
    return cut(out.select(F.monotonically_increasing_id().alias("uid"), "row", "base", "mentions"), "pii-mentions")


def discovered(table: DataFrame, rounds: int = ROUNDS, least_support: int = LEAST_SUPPORT,
               least_share: float = LEAST_SHARE, least_score: float = LEAST_SCORE) -> DataFrame:
    """(instance, kind) of unknown instances that the pattern graph accepts."""
    mentions = table.select(F.explode("mentions").alias("m")).select("m.kind", "m.instance", F.explode("m.patterns").alias("pattern"))
    edges = cut(mentions.groupBy("instance", "pattern").agg(F.min("kind").alias("kind")), "pii-edges")
    share = [f"s{k}" for k in range(len(KINDS))]

    def scored(known):  # the scores of each edge's instance: 1 for a seed of the kind
        if known is None:
            return edges.select("pattern", "instance", *[F.coalesce(F.col("kind") == k, F.lit(False)).cast("double").alias(s)
                                                         for k, s in enumerate(share)])
        return edges.join(known.withColumnsRenamed({s: f"n{s}" for s in share}), "instance", "left").select(
            "pattern", "instance", *[F.when(F.col("kind").isNotNull(), (F.col("kind") == k).cast("double"))
                                     .otherwise(F.coalesce(f"n{s}", F.lit(0.0))).alias(s) for k, s in enumerate(share)])

    known = None
    for _ in range(rounds):
        total = scored(known).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in share])
        rate = {s: F.col(s) / (F.col("n") + DOUBT) for s in share}
        good = {s: (F.col(s) >= least_support) & (rate[s] >= least_share) for s in share}
        any_good = F.lit(False)
        for s in share:
            any_good = any_good | good[s]
        patterns = cut(total.where(any_good).select("pattern", *[F.when(good[s], rate[s]).otherwise(0.0).alias(s) for s in share]), "pii-patterns")
        reached = edges.where("kind is null").join(patterns, "pattern")
        known = cut(reached.groupBy("instance").agg(*[
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col(s), F.lit(0.999)))))).alias(s) for s in share]), "pii-instances")
    top = F.greatest(*share)
    kind = F.lit(None).cast("int")
    for k in reversed(range(len(share))):
        kind = F.when(F.col(share[k]) == top, F.lit(k)).otherwise(kind)
    return known.where(top >= least_score).select("instance", kind.alias("kind"))


def find(docs: DataFrame, keep: list[str], **limits) -> DataFrame:
    """``row``, ``base`` and ``spans`` (arrays of kind, start, end; all spans by kind and start) for every document."""
    table = found_base(docs, keep)
    accepted = cut(discovered(table, **limits), "pii-accepted")
    unknown = table.select("uid", F.explode(F.filter("mentions", lambda m: m.kind.isNull())).alias("m"))
    more = (join_checked(unknown.select("uid", "m.start", "m.end", "m.instance"), accepted, ["instance"], "inner", "pii-known")
            .groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))  # a document's own spans
    joined = join_checked(table.drop("mentions"), more, ["uid"], "left", "pii-more")
    return joined.select("row", "base", F.when(F.col("more").isNull(), F.col("base"))
                         .otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """``row`` with the counts and hash of the base spans and all spans as text."""

    def joined(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(
            ":", F.element_at(F.array(*map(F.lit, KINDS)), x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")

    def counted(number):
        return F.size(F.filter("base", lambda x: x.kind == number)).cast("bigint").alias(f"n_{KINDS[number]}")

    counts = [counted(k) for k in range(len(KINDS))]
    return found.select("row.*", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _redact_batches(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for value, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            text, parts, at = value.as_py(), [], 0
            for s in sorted(spans or (), key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]) if parts else text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "redacted"])


def redact(docs: DataFrame, **limits) -> DataFrame:
    """The documents, each span of their texts replaced by its kind in brackets and ``n_chars`` counted anew."""
    found = find(docs, docs.columns, **limits).select("row", F.col("row.text").alias("text"), "spans")
    changed = map_arrow(found, _redact_batches, f"row {found.schema['row'].dataType.simpleString()}, redacted string")
    kinds = dict(docs.dtypes)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("redacted").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("redacted") == F.col("row.text"), F.col("row.n_chars"))
                           .otherwise(F.length("redacted")).cast(kinds[c]).alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return changed.select(*columns)
