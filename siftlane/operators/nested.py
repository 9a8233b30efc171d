"""Nested detection records flattened to linked tables (problem 2).

One depth-first pass over each record emits a row for every element of every
array, tagged with the flat table it belongs to and with the key of its parent.
The emission is one narrow map stage; nothing is shuffled.  ``write_tables``
writes it partitioned by tag, ``child_table`` applies a tag's schema.

Keys: a detection is ``(id, det_no)``; a signal, subdomain or hop is
``(id, det_no, child_no)`` and its parent is ``(id, det_no)``; an evidence group
is ``(id, 0, child_no)``.  An assessment is ``id``, the parent of the detections
and evidence groups of its log row; without one their parent is the log row.
``p2_found`` has no assessments.

``rest`` of a detection or assessment is the JSON of what has no column: unknown
fields, and values that do not fit their column, with the objects around them;
null if none.  What a hop leaves is in its detection's, by ``hop_no``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("assessment", "detection", "signal", "subdomain", "hop", "evidence_group")
DETECTION_FIELDS = frozenset(("alert", "risk_score", "match_type", "error_count", "context", "signals", "score_breakdown"))

EMITTED = "id BIGINT, det_no BIGINT, child STRING, child_no BIGINT, value STRING, payload STRING"
_ARROW = pa.schema([("id", pa.int64()), ("det_no", pa.int64()), ("child", pa.string()), ("child_no", pa.int64()), ("value", pa.string()), ("payload", pa.string())])

#: The schema of each tag's payload.
PAYLOADS = {
    "assessment": "global_risk DOUBLE, severity STRING, action_tier INT, is_clean BOOLEAN, evidence_count INT, rest STRING",
    "detection": "alert STRING, risk_score DOUBLE, match_type STRING, error_count INT, context STRING, match_layer STRING, pattern STRING, matched_text STRING, token_score DOUBLE, proximity_delta DOUBLE, url_multiplier DOUBLE, url_segment STRING, is_whitelisted BOOLEAN, penalty DOUBLE, anomaly_score DOUBLE, final_risk DOUBLE, url STRING, engine_rev INT, root STRING, segment STRING, sld STRING, tld STRING, path STRING, query STRING, rest STRING",
    "signal": "value STRING",
    "subdomain": "value STRING",
    "hop": "url STRING, status INT",
    "evidence_group": "value STRING",
}

COLUMNS = {tag: dict(c.split() for c in ddl.split(", ")) for tag, ddl in PAYLOADS.items()}
#: The columns that the inner objects of a detection fill.
URL_COLUMNS, SEGMENT_COLUMNS = frozenset(("url", "segment")), frozenset(("sld", "tld", "path", "query"))


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def deep_loads(text: str) -> object:
    """``json.loads`` with an explicit stack, for records nested deeper than the interpreter's own stack."""
    skip = lambda i: _BLANK.match(text, i).end()
    top: list = []
    stack: list[tuple[list | dict, str | None]] = [(top, None)]
    i = skip(0)
    wanted = True  # a value, or else a comma or the end of what is open
    while True:
        box, key = stack[-1]
        ch = text[i : i + 1]
        if wanted:
            if ch in ("[", "{") and ch:
                value: object = [] if ch == "[" else {}
            elif ch == '"':
                value, i = scanstring(text, i + 1)
            elif m := _SCALAR.match(text, i):
                value, i = json.loads(m[0]), m.end()
            else:
                raise ValueError(f"no JSON value at {i}")
            if key is None:
                box.append(value)
            else:
                box[key] = value
            if isinstance(value, (list, dict)):
                stack.append((value, None))
                i = skip(i + 1)
                if text[i : i + 1] == ("]" if isinstance(value, list) else "}"):
                    stack.pop()
                    i += 1
                    wanted = False
                elif isinstance(value, dict):
                    i = _key(text, i, stack)
                i = skip(i)
                continue
            wanted, i = False, skip(i)
        elif box is top:
            if i < len(text):
                raise ValueError(f"more than one JSON value at {i}")
            return top[0]
        elif ch == ",":
            i = skip(i + 1)
            if isinstance(box, dict):
                i = _key(text, i, stack)
            wanted, i = True, skip(i)
        elif ch and ch == ("]" if isinstance(box, list) else "}"):
            stack.pop()
            i = skip(i + 1)
        else:
            raise ValueError(f"no end of an array or object at {i}")


def _key(text: str, i: int, stack: list) -> int:
    """Puts the key at ``i`` on the open object; where its value begins."""
    if text[i : i + 1] != '"':
        raise ValueError(f"no JSON key at {i}")
    key, i = scanstring(text, i + 1)
    i = _BLANK.match(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError(f"no value of a JSON key at {i}")
    stack[-1] = (stack[-1][0], key)
    return i + 1


def deep_dumps(value: object) -> str:
    """``json.dumps`` with an explicit stack."""
    out: list[str] = []
    stack: list = [value]
    text = type("Text", (str,), {})  # parts of the result, apart from strings to write
    while stack:
        x = stack.pop()
        if isinstance(x, text):
            out.append(x)
        elif isinstance(x, (list, dict)) and x:
            parts: list = []
            for k, v in enumerate(x) if isinstance(x, list) else x.items():
                parts += [text(", " if parts else "[" if isinstance(x, list) else "{"), *([] if isinstance(x, list) else [text(json.dumps(k, ensure_ascii=False) + ": ")]), v]
            parts.append(text("]" if isinstance(x, list) else "}"))
            stack += reversed(parts)
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return deep_loads(text)


def dumps(value: object) -> str:
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return deep_dumps(value)


def fits(kind: str | None, value: object) -> bool:
    """Whether a column of this type keeps the value whole."""
    if value is None:
        return kind is not None
    if kind == "STRING":
        return not isinstance(value, (list, dict))
    if kind == "BOOLEAN":
        return isinstance(value, bool)
    if isinstance(value, bool):
        return False
    if kind == "INT":
        return isinstance(value, int) and -(1 << 31) <= value < 1 << 31
    return kind == "DOUBLE" and (isinstance(value, float) or isinstance(value, int) and abs(value) <= 1 << 53)


def parted(tag: str, record: dict, names: frozenset[str] | None = None, apart: tuple[str, ...] = ()) -> tuple[dict, dict]:
    """The fields that have a column, and the others; ``apart`` are in neither."""
    kinds = COLUMNS[tag]
    own, rest = {}, {}
    for k, v in record.items():
        if k not in apart:
            (own if k != "rest" and (names is None or k in names) and fits(kinds.get(k), v) else rest)[k] = v
    return own, rest


def flat_detection(det: dict) -> dict:
    """The columns of a detection out of its nested objects; of two values for a column the outer counts, the other is in ``rest``."""
    score, info = as_object(det.get("score_breakdown")), as_object(as_object(det.get("score_breakdown")).get("url_info"))
    segments = as_object(info.get("segments"))
    holds = lambda record, key: (key,) if key in record and (record[key] is None or isinstance(opened(record[key]), dict)) else ()
    own, rest = parted("detection", det, apart=("signals", *holds(det, "score_breakdown")))
    inner = parted("detection", score, apart=holds(score, "url_info"))
    link = parted("detection", info, URL_COLUMNS, ("hops", *holds(info, "segments")))
    part = parted("detection", segments, SEGMENT_COLUMNS, ("subdomains",))
    out = dict(own)
    for fields, left in (inner, link, part):
        for k, v in fields.items():
            if out.get(k) is None:
                out[k] = v
            elif v is not None and v != out[k]:
                left[k] = v
    hops = {str(k): left for k, x in enumerate(as_list(info.get("hops")), 1) if (left := parted("hop", as_object(x))[1])}
    if hops:
        link[1]["hops"] = hops
    inside = part[1]
    for key, left in (("segments", link[1]), ("url_info", inner[1]), ("score_breakdown", rest)):
        if inside:
            left[key] = inside
        inside = left
    return {**out, "rest": dumps(rest)} if rest else out


def flat_object(tag: str, record: dict, apart: tuple[str, ...] = ()) -> dict:
    own, rest = parted(tag, record, apart=apart)
    return {**own, "rest": dumps(rest)} if rest else own


def opened(value: object) -> object:
    """JSON held inside a JSON string counts as that JSON, however often it is wrapped."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{", '"'):
        try:
            inner = loads(value)
        except ValueError:
            return value
        if not isinstance(inner, (str, list, dict)):
            return value
        value = inner
    return value


def as_list(value: object) -> list:
    """A lone object or string counts as an array of one; null as an empty array."""
    value = opened(value)
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def as_object(value: object) -> dict:
    value = opened(value)
    return value if isinstance(value, dict) else {}


def text_of(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return dumps(value)


def visit(record: object, payload: bool = False) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """Depth first: (tag, det_no, child_no, value, payload) of every element."""
    dump = dumps if payload else (lambda d: None)
    record = opened(record)
    if isinstance(record, dict) and ("detections" in record or not DETECTION_FIELDS & record.keys()):
        if record:
            yield "assessment", 0, 0, text_of(record.get("severity")), dump(flat_object("assessment", record, ("detections", "evidence_groups"))) if payload else None
        for k, group in enumerate(as_list(record.get("evidence_groups")), 1):
            if group is not None:
                yield "evidence_group", 0, k, text_of(group), dump({"value": text_of(group)})
        found = as_list(record.get("detections"))
    else:
        found = as_list(record)
    for d, det in enumerate(found, 1):
        det = opened(det)
        if not isinstance(det, dict):
            continue
        info = as_object(as_object(det.get("score_breakdown")).get("url_info"))
        yield "detection", d, 0, text_of(det.get("match_type")), dump(flat_detection(det)) if payload else None
        for k, x in enumerate(as_list(det.get("signals")), 1):
            if x is not None:
                yield "signal", d, k, text_of(x), dump({"value": text_of(x)})
        for k, x in enumerate(as_list(as_object(info.get("segments")).get("subdomains")), 1):
            if x is not None:
                yield "subdomain", d, k, text_of(x), dump({"value": text_of(x)})
        for k, x in enumerate(as_list(info.get("hops")), 1):
            x = opened(x)
            url = x.get("url") if isinstance(x, dict) else x
            if x is not None:
                yield "hop", d, k, text_of(url), dump(parted("hop", x)[0] if isinstance(x, dict) else {"url": text_of(x)}) if payload else None


def flatten(df: DataFrame, id_col: str = "id", json_col: str = "detections_json", payload: bool = False) -> DataFrame:
    """Every element of the nested records in ``json_col`` as one tagged row.

    Null, empty or broken JSON, and JSON that is a number or a truth value, gives
    no rows; a null key is kept as null; repeated rows are flattened each by
    itself; unknown fields are kept in ``rest``; other columns of ``df`` are not read.
    A record may be nested as deep as its text is long.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = loads(text)
                except ValueError:
                    continue
                for tag, d, k, value, rest in visit(record, payload):
                    for col, x in zip(cols, (key, d, tag, k, value, rest)):
                        col.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    # "[]" and the like hold nothing: they need not cross to Python
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("j")).where(F.length("j") > 2)
    return narrow.mapInArrow(emit, EMITTED)


def found(df: DataFrame) -> DataFrame:
    return flatten(df).where("child <> 'assessment'").select("id", "det_no", "child", "child_no", "value")


def child_table(emitted: DataFrame, tag: str) -> DataFrame:
    """One flat table with its schema applied, with the keys of its parents."""
    if tag not in TAGS:
        raise ValueError(f"no such table: {tag}")
    rows = emitted.where(F.col("child") == tag)
    keys = ["id"] if tag in ("assessment", "evidence_group") else ["id", "det_no"]
    own = [] if tag in ("assessment", "detection") else [F.col("child_no").alias(f"{tag}_no")]
    return rows.select(*keys, *own, F.from_json("payload", PAYLOADS[tag]).alias("p")).select(*keys, *([f"{tag}_no"] if own else []), "p.*")


def write_tables(emitted: DataFrame, path: str) -> None:
    """All flat tables in one pass, one folder ``child=TAG`` each."""
    emitted.write.mode("overwrite").partitionBy("child").parquet(path)
