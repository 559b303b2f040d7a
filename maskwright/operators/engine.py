"""The engine: configuration, and scanning and sanitizing of text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import resolve
from maskwright.functions.detectors import REGISTRY, Detector, Finding, for_locale
from maskwright.functions.entities import DENY, VARIANTS, by_name
from maskwright.operators.masking import REDACT, Strategy, with_mask
from maskwright.shipping import ship_package, spread

FINDING_DDL = "struct<entity_type:string,start:int,end:int,cstart:int,cend:int,text:string,confidence:double,recognizer_id:string,applies:boolean>"
FINDING = pa.struct(
    [("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cstart", pa.int32()), ("cend", pa.int32()), ("text", pa.string()),
     ("confidence", pa.float64()), ("recognizer_id", pa.string()), ("applies", pa.bool_())]
)
MAPPING_DDL = "struct<placeholder:string,entity_type:string,original:string,span_start:int,span_end:int,confidence:double,recognizer_id:string>"
_MAPPING = pa.struct(
    [("placeholder", pa.string()), ("entity_type", pa.string()), ("original", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()),
     ("confidence", pa.float64()), ("recognizer_id", pa.string())]
)
LOCALES = ("Universal", "US", "NL", "UK", "DE", "FR", "IN", "BR", "EU")
ARROW_ROWS = 1000


class ConfigError(ValueError):
    """A configuration that is rejected before any job starts."""


@dataclass(frozen=True)
class Config:
    """What to look for. Unknown names and bad numbers raise on construction."""

    locale: str = "Universal"
    min_confidence: float = 0.0
    exclude: tuple[str, ...] = ()
    allow: tuple[str, ...] = field(default=(), repr=False)
    deny: tuple[str, ...] = field(default=(), repr=False)
    strategy: Strategy | None = REDACT
    extra: tuple[Detector, ...] = field(default=(), repr=False)
    only: tuple[str, ...] | None = None
    #: True: every detector's findings, also those that overlap others.
    overlaps: bool = False

    def __post_init__(self) -> None:
        if not 0.0 <= self.min_confidence <= 1.0:
            raise ConfigError("min_confidence must lie between 0 and 1")
        object.__setattr__(self, "exclude", tuple(x if x in VARIANTS or x.startswith('Custom("') else by_name(x) for x in self.exclude))
        object.__setattr__(self, "allow", tuple(x for x in self.allow if x))
        object.__setattr__(self, "deny", tuple(x for x in self.deny if x))
        if not self.registry():
            raise ConfigError("no detectors")

    def registry(self) -> tuple[Detector, ...]:
        return tuple(d for d in REGISTRY if self.only is None or d.id in self.only) + self.extra

    def detectors(self) -> tuple[Detector, ...]:
        """Detectors that can matter: of the locale, and but for excluded built-in types, which each emit one type."""
        known = self.__dict__.get("_detectors")
        if known is None:
            ours = {d.id for d in REGISTRY}
            known = tuple(d for d in for_locale(self.locale, self.registry()) if not (d.id in ours and d.entity_type in self.exclude))
            object.__setattr__(self, "_detectors", known)
        return known

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_detectors"}

    def findings(self, text: str) -> list[Finding]:
        """Findings of one text, with code-point offsets."""
        return resolve.scan(text, self.detectors(), self.min_confidence, frozenset(self.exclude), self.allow, self.deny, self.overlaps)


def finding_rows(text: str, findings: list[Finding]) -> list[dict]:
    """Findings with byte and code-point offsets, and whether each one is masked."""
    masked = set(map(id, resolve.disjoint(findings)))
    plain, at, byte = text.isascii(), 0, 0
    out = []
    where: dict[int, int] = {}
    if not plain:
        for c in sorted({x for f in findings for x in (f.start, f.end)}):
            byte += len(text[at:c].encode())
            at = c
            where[c] = byte
    for f in findings:
        s, e = (f.start, f.end) if plain else (where[f.start], where[f.end])
        out.append({"entity_type": f.entity_type, "start": s, "end": e, "cstart": f.start, "cend": f.end, "text": f.text, "confidence": f.confidence, "recognizer_id": f.recognizer_id, "applies": id(f) in masked})
    return out


def _byte_spans(text: str, found: list[Finding]) -> tuple[list[int], list[int]]:
    """Starts and ends of findings in bytes."""
    if text.isascii():
        return [f.start for f in found], [f.end for f in found]
    where, byte, at = {}, 0, 0
    for c in sorted({x for f in found for x in (f.start, f.end)}):
        byte += len(text[at:c].encode())
        where[c] = byte
        at = c
    return [where[f.start] for f in found], [where[f.end] for f in found]


def _lists(offsets: list[int], columns: Iterable[Iterable], kind: pa.StructType) -> pa.Array:
    """Arrays of structs from the columns of all their elements."""
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def finding_array(texts: list[str | None], found: list[list[Finding]]) -> pa.Array:
    """What finding_rows gives for each text, made column by column."""
    offsets, flat, starts, ends, applies = [0], [], [], [], []
    for t, fs in zip(texts, found):
        if fs:
            flat += fs
            s, e = _byte_spans(t, fs)
            starts += s
            ends += e
            if len(fs) == 1:
                applies.append(True)
            else:
                masked = set(map(id, resolve.disjoint(fs)))
                applies += [id(f) in masked for f in fs]
        offsets.append(len(flat))
    kinds, cstarts, cends, values, confidences, ids = zip(*flat) if flat else [()] * 6
    return _lists(offsets, (kinds, starts, ends, cstarts, cends, values, confidences, ids, applies), FINDING)


def with_column(df: DataFrame, source: str, target: str, make: Callable[[list[str | None]], pa.Array], ddl: str) -> DataFrame:
    """df with a column made from the texts of another, in one crossing to Python."""
    ship_package(df.sparkSession)
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, make(b.column(at).to_pylist())], names=[*b.schema.names, target])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return spread(df).mapInArrow(run, f"{schema}, `{target}` {ddl}")


def scan_column(df: DataFrame, text: str, config: Config = Config(), target: str = "findings") -> DataFrame:
    """df with an array of findings of a text column; null texts have none."""
    def make(texts: list[str | None]) -> pa.Array:
        return finding_array(texts, [config.findings(t) if t else [] for t in texts])

    return with_column(df, text, target, make, f"array<{FINDING_DDL}>")


def scan(df: DataFrame, text: str, config: Config = Config()) -> DataFrame:
    """df with findings, masked_text (unless the strategy is None) and stats."""
    out = scan_column(df, text, config)
    f = F.col("findings")
    by_type = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(f["entity_type"])), lambda t: F.struct(t, F.size(F.filter(f, lambda x: x["entity_type"] == t)).cast("long"))))
    if config.strategy is not None:
        out = with_mask(out, "masked_text", F.col(text), f, config.strategy)
    return out.withColumn("stats", F.struct(F.size(f).cast("long").alias("total_findings"), by_type.alias("findings_by_type"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes_scanned")))


def findings_table(df: DataFrame, keys: Iterable[str], text: str, config: Config = Config()) -> DataFrame:
    """One row per finding with the key columns; texts without findings give none."""
    keys = list(keys)
    found = scan_column(df.select(*keys, text), text, config)
    return found.select(*keys, F.inline("findings"))


def mask_findings(df: DataFrame, text: str, findings: str = "findings", strategy: Strategy = REDACT, target: str = "masked_text") -> DataFrame:
    """df with its text masked by findings from elsewhere: structs with entity_type and the byte span start, end; confidence counts in overlaps if it is there.

    A span that is empty, out of the text or within a character fails the query.
    """
    ship_package(df.sparkSession)
    i, j = df.columns.index(text), df.columns.index(findings)

    def one(t: str | None, rows: list[dict] | None) -> list[dict]:
        raw = (t or "").encode()
        made = []
        for r in rows or ():
            if not 0 <= r["start"] < r["end"] <= len(raw):
                raise ValueError("a finding's span lies outside its text")
            try:
                value = raw[r["start"]: r["end"]].decode()
            except UnicodeDecodeError:
                raise ValueError("a finding's span cuts a character") from None
            made.append(Finding(r["entity_type"], r["start"], r["end"], value, r.get("confidence") or 0.0, r.get("recognizer_id") or ""))
        # Byte offsets serve for both kinds: masks cut bytes.
        return [{"entity_type": f.entity_type, "start": f.start, "end": f.end, "cstart": f.start, "cend": f.end, "text": f.text, "confidence": f.confidence, "recognizer_id": f.recognizer_id, "applies": True} for f in resolve.disjoint(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([one(t, f) for t, f in zip(b.column(i).to_pylist(), b.column(j).to_pylist())], pa.list_(FINDING))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "__applied"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = spread(df).mapInArrow(run, f"{schema}, __applied array<{FINDING_DDL}>")
    return with_mask(out, target, F.col(text), F.col("__applied"), strategy).drop("__applied")


def sanitize(df: DataFrame, text: str, config: Config = Config(), style: str = "brackets") -> DataFrame:
    """df with ``clean_text`` and its restore ``mapping``; treat the mapping as a secret."""
    def make(texts: list[str | None]) -> pa.Array:
        offsets, cleaned, marks, flat, starts, ends = [0], [], [], [], [], []
        for t in texts:
            clean, mapping = (None, ()) if t is None else resolve.sanitize(t, config.findings(t), style)
            cleaned.append(clean)
            if mapping:
                fs = [f for _, f in mapping]
                s, e = _byte_spans(t, fs)
                marks += [p for p, _ in mapping]
                flat += fs
                starts += s
                ends += e
            offsets.append(len(flat))
        kinds, _, _, values, confidences, ids = zip(*flat) if flat else [()] * 6
        entries = _lists(offsets, (marks, kinds, values, starts, ends, confidences, ids), _MAPPING)
        return pa.StructArray.from_arrays([pa.array(cleaned, pa.string()), entries], ["clean_text", "mapping"])

    out = with_column(df, text, "__sanitized", make, f"struct<clean_text:string,mapping:array<{MAPPING_DDL}>>")
    return out.select(*df.columns, F.col("__sanitized.clean_text").alias("clean_text"), F.col("__sanitized.mapping").alias("mapping"))


def mapping_table(sanitized: DataFrame, keys: Iterable[str]) -> DataFrame:
    return sanitized.select(*keys, F.inline("mapping"))


def restore(df: DataFrame, text: str, mapping: str = "mapping", target: str = "restored", strict: bool = False) -> DataFrame:
    """df with a text whose placeholders are put back, by the row's own mapping."""
    ship_package(df.sparkSession)
    i, j = df.columns.index(text), df.columns.index(mapping)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entries, out, at = b.column(j).flatten(), [], 0
            marks, originals = (pc.struct_field(entries, c).to_pylist() for c in ("placeholder", "original"))
            for t, n in zip(b.column(i).to_pylist(), pc.list_value_length(b.column(j)).to_pylist()):
                upto = at + (n or 0)
                out.append(None if t is None else resolve.restore(t, zip(marks[at:upto], originals[at:upto]), strict))
                at = upto
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, target])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{target}` string")


def mask_text(text: str, findings: list[Finding], replacements: Callable[[Finding], str]) -> str:
    """The masked form of one text, for formats that rebuild whole documents."""
    out, at = [], 0
    for f in resolve.disjoint(findings):
        out += [text[at: f.start], replacements(f)]
        at = f.end
    return "".join(out) + text[at:]


__all__ = ["Config", "ConfigError", "DENY", "findings_table", "mapping_table", "mask_findings", "mask_text", "replace", "restore", "sanitize", "scan", "scan_column"]
