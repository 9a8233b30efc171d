"""Scores where the hits are found: links, fallback, detections and evidence of a message in one Arrow stage.

Positions, terms and links of a message are at hand in the matching stage, so its scores
are worked out there too, and only tiers and gates are columns.  ``assess`` has the same
as columns (``with_detections_by_columns``), which the tests compare with this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from siftlane import config as c
from siftlane.operators.matching import Matcher, as_nested, spread

# What counts as a link, and as a link-like text.
LINK = re.compile(r"(?:[hH][tT][tT][pP][sS]?://|[wW]{3}\.)\S+|\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/\S*)?")
LINK_LIKE = re.compile(r"\b(?:https?://|www\.)\S+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?")
OBFUSCATED = re.compile(r"(?<!\w)[a-z]+[0-9@$]+[a-z]+(?!\w)")
_SECOND_LEVEL = ("com", "gov", "org", "edu", "net")
#: Links, and their classes, that a worker remembers.
CACHED_LINKS = 100_000

_INFO = pa.struct([("multiplier", pa.float64()), ("segment", pa.string()), ("is_whitelisted", pa.bool_()), ("url", pa.string()), ("expanded_url", pa.string()), ("unmasked_root", pa.string()), ("destination_risky", pa.bool_())])
_ANOMALY = pa.struct([("score", pa.float64()), ("signals", pa.list_(pa.string()))])
_DETECTION = pa.struct(
    [("alert", pa.string()), ("risk_score", pa.float64()), ("match_type", pa.string()), ("error_count", pa.int32()), ("context", pa.string()), ("signals", pa.list_(pa.string())), ("pattern", pa.string())]
    + [("matched_text", pa.string()), ("root", pa.string()), ("token_score", pa.float64()), ("proximity_delta", pa.float64()), ("url_multiplier", pa.float64()), ("url_segment", pa.string())]
    + [("is_whitelisted", pa.bool_()), ("penalty", pa.float64()), ("anomaly_score", pa.float64()), ("evidence_group", pa.string())]
)
#: What the stage adds.
SCORED = "url_info STRUCT<multiplier: DOUBLE, segment: STRING, is_whitelisted: BOOLEAN, url: STRING, expanded_url: STRING, unmasked_root: STRING, destination_risky: BOOLEAN>, anomaly STRUCT<score: DOUBLE, signals: ARRAY<STRING>>, detections ARRAY<STRUCT<alert: STRING, risk_score: DOUBLE, match_type: STRING, error_count: INT, context: STRING, signals: ARRAY<STRING>, pattern: STRING, matched_text: STRING, root: STRING, token_score: DOUBLE, proximity_delta: DOUBLE, url_multiplier: DOUBLE, url_segment: STRING, is_whitelisted: BOOLEAN, penalty: DOUBLE, anomaly_score: DOUBLE, evidence_group: STRING>>, n_layer_hits INT, global_risk DOUBLE, evidence_groups ARRAY<STRING>"
NO_LINK = (1.0, "none", False, None, None, None, False)


def rounded(x: float, step: Decimal = Decimal("0.001")) -> float:
    """Three decimals, ties away from zero, as the SQL engines round."""
    return float(Decimal(repr(x)).quantize(step, ROUND_HALF_UP))


class Parts:
    """Host labels, path and query of a link, and its registered root."""

    def __init__(self, url: str) -> None:
        rest, _, self.query = re.sub(r"^[hH][tT][tT][pP][sS]?://", "", url).partition("?")
        name, _, self.path = rest.partition("/")
        labels = re.sub(r":[0-9]{1,5}$", "", name).split(".")
        self.subdomains = labels[:-2]
        self.sld = labels[-2] if len(labels) >= 2 else ""
        self.host = ".".join([*self.subdomains, self.sld, labels[-1]]).lower()
        named = [x.lower() for x in (*self.subdomains, self.sld, labels[-1]) if x]
        self.root = ".".join(named[-3 if len(named) >= 3 and named[-2] in _SECOND_LEVEL else -2 :])


def under(name: str, domains: tuple[str, ...]) -> bool:
    return any(name == d or name.endswith("." + d) for d in domains)


class Scorer(Matcher):
    """A matcher that also scores."""

    def __init__(self, cfg: c.EngineConfig) -> None:
        super().__init__(cfg)
        brands = [cfg.norm(b) for category, b in cfg.dictionary if category in cfg.brand_category and b.lower() not in cfg.generic_brands]
        self.long_brands = [b for b in brands if len(b) >= cfg.lookalike_chars]
        self.short_brands = frozenset(b for b in brands if 0 < len(b) < cfg.lookalike_chars)
        self.groups = cfg.groups
        self.links: dict[tuple[str, str | None], tuple | None] = {}

    def norm(self, text: str) -> str:
        return text.lower().translate(self.table)

    # --- links --------------------------------------------------------------

    def lookalike(self, root: str) -> bool:
        label = root.split(".", 1)[0].lower()
        if not label:
            return False
        name = self.norm(label)
        return any(b in name for b in self.long_brands) or not self.short_brands.isdisjoint(self.norm(x) for x in re.split(r"[^a-z0-9]+", label) if x)

    def structure(self, p: Parts) -> str | None:
        """The structural class of a link whose root is not verified: that of the first pattern that stands in it."""
        if self.cfg.flag_lookalikes and self.lookalike(p.root):
            return "lookalike"
        if self.exact is None:
            return None
        best: tuple[int, int] | None = None
        for rank, text in [*((0, s) for s in p.subdomains), (1, p.path), (2, p.query), (3, p.sld)]:
            for _, (_, js) in self.exact.iter(self.norm(text)):
                if best is None or (js[0], rank) < best:
                    best = (js[0], rank)
        return None if best is None else ("subdomain", "path", "query", "sld")[best[1]]

    @staticmethod
    def unwrapped(url: str | None) -> str | None:
        """The destination inside a tracking link, up to three deep."""
        for _ in range(3):
            if url is None:
                return None
            m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
            if not m or not under(m[1].lower(), c.TRACKERS):
                return url
            for key in ("u", "url", "target", "destination"):
                v = re.search(rf"[?&]{key}=([^&#]*)", url)
                if v and not re.search(r"%(?![0-9A-Fa-f]{2})", v[1]) and re.match(r"[hH][tT][tT][pP][sS]?://[^/?#]+", inner := unquote_plus(v[1])):
                    url = inner
                    break
        return url

    def classified(self, url: str, resolved: str | None) -> tuple | None:
        """What one link says, as the fields of ``url_info``, or None."""
        key = (url, resolved)
        if key not in self.links:
            if len(self.links) >= CACHED_LINKS:
                self.links.clear()
            self.links[key] = self._classified(url, resolved)
        return self.links[key]

    def _classified(self, url: str, resolved: str | None) -> tuple | None:
        p = Parts(url)
        info = lambda segment, *rest: (c.MULTIPLIERS.get(segment), segment, *rest)
        if not under(p.host, self.cfg.shorteners):
            if p.root in self.cfg.legitimate:
                return info("sld", True, url, None, None, False)
            segment = self.structure(p)
            return segment and info(segment, False, url, None, None, False)
        to = self.unwrapped(resolved)
        q = Parts(to or "")
        # a destination that is the link itself, or another shortened link, resolves nothing
        if resolved is None or resolved == url or under(q.host, self.cfg.shorteners):
            return info("shortener", False, url, url, None, False)
        if q.root in self.cfg.legitimate:
            return info("sld", True, url, to, q.root, False)
        if (segment := self.structure(q)) in c.RISKY_SEGMENTS:
            return info(segment, False, url, to, q.root, True)
        return info("none", False, url, to, q.root, False)

    def link_info(self, text: str, known: dict[str, str] | None) -> tuple:
        """The riskiest link: highest multiplier, on a tie one that is not verified, then the first."""
        best, asked = None, 0
        for url in LINK.findall(text) if "." in text or "://" in text else ():
            to = None
            if known is not None and under(Parts(url).host, self.cfg.shorteners):
                asked += 1
                to = known.get(url) if asked <= self.cfg.max_lookups else None
            x = self.classified(url, to)
            if x and (best is None or x[0] > best[0] or (x[0] == best[0] and best[2] and not x[2])):
                best = x
        return best or NO_LINK

    # --- scores -------------------------------------------------------------

    def anomaly(self, text: str, obfuscated: bool) -> tuple[float, list[str]]:
        """The dictionary-free heuristic; steps in order, each capped."""
        n = self.norm(text)
        digits = sum(x.isdecimal() for x in text) / max(len(text), 1) >= 0.08
        # Steps, their amounts and names.
        steps = (
            (any(t in n for t in c.URGENCY_TERMS), 0.22, "urgency language"), (any(t in n for t in c.ACTION_TERMS), 0.20, "action request"), (any(t in n for t in c.SENSITIVE_TERMS), 0.28, "credential or payment language"),
            (any(t in n for t in c.BENIGN_TERMS), -0.18, "benign context"), (bool(LINK_LIKE.search(n)), 0.18, "URL-like text"), (obfuscated, 0.12, "obfuscated spelling"), (digits, 0.08, "digit-heavy content"),
        )
        score, signals = 0.0, []
        for on, by, label in steps:
            if on:
                score = min(1.0, score + by) if by > 0 else max(0.0, score + by)
                signals.append(label)
        return rounded(score), signals[:4]

    def proximity(self, size: int, terms: list[tuple], at: int) -> float:
        low, high = max(0, at - self.cfg.window), min(size, at + self.cfg.window)
        total = 0.0
        for a, n, weight in terms:
            if a >= low and a + n <= high:
                total += weight / (abs(a - at) + 1)
        return max(-1.0, min(1.0, total))

    def layer_detections(self, text: str, hits: list[tuple], info: tuple) -> list[tuple]:
        """The scored detections of the dictionary layers that reach their threshold."""
        cfg, out = self.cfg, []
        terms = self.weights(text) if hits else []
        for layer, j, errors, _, _, at, matched, root in hits:
            delta = self.proximity(len(text), terms, at)
            base = 1.25 if layer == "exact" else 1.0
            penalty = errors * 0.1 if layer == "fuzzy" else 0.15 if layer == "affix" else 0.0
            risk = (base + delta - penalty) * info[0]
            least = cfg.exact_threshold if layer == "exact" else cfg.fuzzy_threshold - errors * 0.15 if layer == "fuzzy" else cfg.affix_threshold
            if risk < least:
                continue
            pattern = cfg.dictionary[j][1]
            # The texts of the alerts.
            how = f" (fuzzy match, {errors} error(s))" if layer == "fuzzy" else f" (affix match: '{matched}' -> root '{root}')" if layer == "affix" else ""
            context = text[max(0, at - 20) : min(len(text), at + 20)].lower().strip()
            out.append((f"CRITICAL: '{pattern}' detected!{how}", rounded(risk), layer, errors, context, None, pattern, matched, root, base, rounded(delta), info[0], info[1], info[2], rounded(penalty), None, self.groups[j]))
        return out

    def scored(self, text: str, known: dict[str, str] | None) -> tuple:
        """The values of ``SCORED`` for one message."""
        info = self.link_info(text, known)
        found = self.layer_detections(text, self.hits(text), info)
        n = len(found)
        obfuscated = bool(OBFUSCATED.search(text.lower()))
        score, signals = self.anomaly(text, obfuscated)
        head = text[:120].lower().strip()
        extra = lambda alert, risk, kind, signs, pattern, matched, mult, segment, odd: (alert, risk, kind, 0, head, signs, pattern, matched, None, 0.0, 0.0, mult, segment, False, 0.0, odd, None)
        # The texts of the alerts.
        if not found and score >= self.cfg.anomaly_threshold:
            found.append(extra("SUSPICIOUS: no known pattern matched, but the message contains phishing-like signals.", rounded(0.95 + score * 0.4), "anomaly", signals, "ANOMALY_HEURISTIC", ", ".join(signals), 1.0, "none", score))
        if info[1] == "shortener" and not info[2]:
            found.append(extra("CRITICAL: Unverified shortened URL detected!", 2.5, "url_shortener", ["unverified shortened URL"], "UNVERIFIED_SHORTENER", info[4] if info[4] is not None else text[:120], 2.5, "shortener", None))
        elif info[6]:
            found.append(extra("CRITICAL: Shortened link leads to a risky destination!", info[0], "url_shortener", ["risky shortened-link destination"], "SHORTENED_LINK_DESTINATION", info[4] or "", info[0], info[1], None))
        groups: set[str | None] = set()
        for x in found:
            groups.add(x[16])
            groups.update(c.EVIDENCE_OF_SIGNAL.get(s) for s in x[5] or ())
            groups.add("obfuscation" if x[2] == "fuzzy" else None)
            groups.add("url_risk" if x[12] in c.RISKY_SEGMENTS and not x[13] else None)
        if found:
            groups.add("obfuscation" if obfuscated else None)
            groups.add("url_risk" if info[1] in c.RISKY_SEGMENTS and not info[2] else None)
        return info, (score, signals), found, n, max((x[1] for x in found), default=0.0), sorted(g for g in groups if g)


@lru_cache(2)
def scorer(cfg: c.EngineConfig) -> Scorer:
    """Built once in a worker, however many tasks it runs."""
    return Scorer(cfg)


def _struct(rows: list[tuple], kind: pa.StructType) -> pa.Array:
    columns = list(zip(*rows)) or [()] * kind.num_fields
    return pa.StructArray.from_arrays([pa.array(x, kind.field(i).type) for i, x in enumerate(columns)], fields=[kind.field(i) for i in range(kind.num_fields)])


def scored(df: DataFrame, cfg: c.EngineConfig, text: str, known: str | None = None, even: bool = True) -> DataFrame:
    """``df`` with the columns of ``SCORED``; ``text`` has no nulls, ``known`` is a column of resolved links, a map.

    A table in fewer partitions than cores is dealt out first (see ``spread``), unless ``even`` is false.
    """
    shared = df.sparkSession.sparkContext.broadcast(cfg)  # a dictionary of bounded size
    names = [f.split()[0] for f in ("url_info", "anomaly", "detections", "n_layer_hits", "global_risk", "evidence_groups")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            links = [None if x is None else dict(x) for x in batch.column(known).to_pylist()] if known else [None] * len(texts)
            # a message without any resolved link still counts its lookups
            rows = [own.scored(t, (x or {}) if known else None) for t, x in zip(texts, links)]
            info, odd, found, n, risk, groups = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [], [])
            added = [_struct(info, _INFO), _struct(odd, _ANOMALY), as_nested(found, _DETECTION), pa.array(n, pa.int32()), pa.array(risk, pa.float64()), pa.array(groups, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *added], [*batch.schema.names, *names])

    df = df.drop(*names)
    df = spread(df) if even else df
    schema = StructType(df.schema.fields + StructType.fromDDL(SCORED).fields)
    return df.mapInArrow(run, schema)
