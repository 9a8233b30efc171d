"""From messages to assessments: scores, links, fallback, tiers, evidence, gate.

``assess`` is one narrow plan: hits and their scores come from one Arrow stage
(``scoring``), tiers and gates are columns; the scores as columns are kept as a check.
Only the resolution of shortened links joins (with the lookup table
``resolutions``), and only the few messages that hold one take part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane import config as c
from siftlane.functions import text as tx
from siftlane.functions import urls as ux
from siftlane.operators.matching import with_hits
from siftlane.operators.scoring import scored


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row.

    Plain projections are inlined into every later use and filter, which repeats costly
    expressions many times over; a generated column is a border that they do not cross.
    """
    struct = F.struct(*[col.alias(name) for name, col in columns.items()])
    out = df.drop(*columns).select("*", F.explode(F.array(struct)).alias("_held"))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_held"], *[F.col(f"_held.{name}").alias(name) for name in columns])


_NONE = "STRUCT<multiplier: DOUBLE, segment: STRING, is_whitelisted: BOOLEAN, url: STRING, expanded_url: STRING, unmasked_root: STRING, destination_risky: BOOLEAN>"


def _info(segment: Column, white: Column, url: Column, expanded: Column, root: Column, risky: Column) -> Column:
    return F.struct(
        ux.multiplier(segment).alias("multiplier"), segment.alias("segment"), white.alias("is_whitelisted"), url.alias("url"),
        expanded.cast("string").alias("expanded_url"), root.cast("string").alias("unmasked_root"), risky.alias("destination_risky"),
    )


def classified(url: Column, resolved: Column, cfg: c.EngineConfig) -> Column:
    """What one link says, or null: ``resolved`` is the destination of a shortened link, if known."""
    no = F.lit(False)

    def direct(p: Column) -> Column:
        plain = F.when(ux.is_legitimate(p, cfg), _info(F.lit("sld"), F.lit(True), url, F.lit(None), F.lit(None), no)).otherwise(
            ux.let(ux.structure(p, cfg), lambda s: F.when(s.isNotNull(), _info(s, no, url, F.lit(None), F.lit(None), no)))
        )
        return F.when(ux.is_shortener(p, cfg), ux.let(F.struct(ux.unwrapped(resolved).alias("to")), shortened)).otherwise(plain)

    def shortened(d: Column) -> Column:
        def of(q: Column) -> Column:
            # a destination that is the link itself, or another shortened link, resolves nothing
            known = F.coalesce(resolved.isNotNull() & (resolved != url) & ~ux.is_shortener(q, cfg), no)
            seen = F.struct(ux.root(q).alias("root"), ux.structure(q, cfg).alias("segment"))
            return F.when(~known, _info(F.lit("shortener"), no, url, url, F.lit(None), no)).otherwise(
                ux.let(
                    seen,
                    lambda x: F.when(x["root"].isin(*cfg.legitimate), _info(F.lit("sld"), F.lit(True), url, d["to"], x["root"], no))
                    .when(x["segment"].isin(*c.RISKY_SEGMENTS), _info(x["segment"], no, url, d["to"], x["root"], F.lit(True)))
                    .otherwise(_info(F.lit("none"), no, url, d["to"], x["root"], no)),
                )
            )

        return ux.let(ux.parts(F.coalesce(d["to"], F.lit(""))), of)

    return ux.let(ux.parts(url), direct)


def worst(infos: Column) -> Column:
    """The riskiest link: highest multiplier, on a tie one that is not verified, then the first."""
    return F.aggregate(
        F.filter(infos, lambda x: x.isNotNull()),
        F.lit(None).cast(_NONE),
        lambda best, x: F.when(
            best.isNull() | (x["multiplier"] > best["multiplier"]) | ((x["multiplier"] == best["multiplier"]) & best["is_whitelisted"] & ~x["is_whitelisted"]), x
        ).otherwise(best),
    )


def with_known(df: DataFrame, cfg: c.EngineConfig, resolutions: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_known``, the destinations of the first shortened links in ``_urls``: ``max_lookups`` a message."""
    short = F.filter("_urls", lambda u: ux.is_shortener(ux.parts(u), cfg))
    asked = df.select(key, F.slice(short, 1, cfg.max_lookups).alias("asked")).where(F.size("asked") > 0).select(key, F.explode("asked").alias("url"))
    known = resolutions.where(F.col("destination").isNotNull()).groupBy("url").agg(F.min("destination").alias("destination"))
    # max_lookups entries a message at most
    found = asked.distinct().join(known, "url").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("url", "destination"))).alias("_known"))
    return df.join(found, key, "left")


def with_url_info(df: DataFrame, cfg: c.EngineConfig, resolutions: DataFrame | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """``df`` with ``url_info``, the worst link of each message.

    ``resolutions(url, destination)`` replaces the network; without it every shortened
    link stays unresolved.  The first ``max_lookups`` shortened links of a message are
    looked up.  ``key`` must be unique.
    """
    df = held(df, _urls=tx.urls(F.coalesce(F.col(text), F.lit(""))))
    if resolutions is None:
        infos = F.transform("_urls", lambda u: classified(u, F.lit(None).cast("string"), cfg))
    else:
        df = with_known(df, cfg, resolutions, key)
        rank = F.transform("_urls", lambda u, i: F.struct(u.alias("u"), F.size(F.filter(F.slice("_urls", F.lit(1), i + 1), lambda v: ux.is_shortener(ux.parts(v), cfg))).alias("nth")))
        infos = F.transform(rank, lambda x: classified(x["u"], F.when(x["nth"] <= cfg.max_lookups, F.try_element_at(F.col("_known"), x["u"])), cfg))
    none = F.struct(
        F.lit(1.0).alias("multiplier"), F.lit("none").alias("segment"), F.lit(False).alias("is_whitelisted"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("expanded_url"), F.lit(None).cast("string").alias("unmasked_root"), F.lit(False).alias("destination_risky"),
    )
    # messages without any link need no classification
    info = F.when(F.size("_urls") == 0, none).otherwise(F.coalesce(worst(infos), none))
    out = held(df, url_info=info).drop("_urls")
    return out.drop("_known") if resolutions is not None else out


def proximity(text: Column, terms: Column, at: Column, window: int) -> Column:
    """Nearness of boosters and neutralizers around ``at``: each adds its weight over its distance; clamped to one."""
    low, high = F.greatest(F.lit(0), at - window), F.least(F.length(text), at + window)
    near = F.filter(terms, lambda t: (t["at"] >= low) & (t["at"] + t["size"] <= high))
    total = F.aggregate(near, F.lit(0.0), lambda acc, t: acc + t["weight"] / (F.abs(t["at"] - at) + 1))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))


def detections(text: Column, hits: Column, terms: Column, info: Column, cfg: c.EngineConfig) -> Column:
    """The scored detections of the dictionary layers that reach their threshold."""
    patterns = F.array(*[F.lit(p) for _, p in cfg.dictionary])
    groups = F.array(*[F.lit(g) for g in cfg.groups])
    mult = info["multiplier"]

    def score(h: Column) -> Column:
        delta = proximity(text, terms, h["at"], cfg.window)
        layer = h["layer"]
        base = F.when(layer == "exact", 1.25).otherwise(1.0)
        penalty = F.when(layer == "fuzzy", h["errors"] * 0.1).when(layer == "affix", 0.15).otherwise(0.0)
        return F.struct(h.alias("hit"), delta.alias("delta"), base.alias("base"), penalty.alias("penalty"), ((base + delta - penalty) * mult).alias("risk"))

    def enough(s: Column) -> Column:
        layer = s["hit"]["layer"]
        return s["risk"] >= F.when(layer == "exact", cfg.exact_threshold).when(layer == "fuzzy", cfg.fuzzy_threshold - s["hit"]["errors"] * 0.15).otherwise(cfg.affix_threshold)

    def shaped(s: Column) -> Column:
        h = s["hit"]
        pattern = F.element_at(patterns, h["idx"] + 1)
        alert = F.concat(
            F.lit("CRITICAL: '"), pattern, F.lit("' detected!"),
            F.when(h["layer"] == "fuzzy", F.concat(F.lit(" (fuzzy match, "), h["errors"].cast("string"), F.lit(" error(s))")))
            .when(h["layer"] == "affix", F.concat(F.lit(" (affix match: '"), h["matched"], F.lit("' -> root '"), h["root"], F.lit("')")))
            .otherwise(F.lit("")),
        )
        none = F.lit(None)
        return F.struct(
            alert.alias("alert"), F.round(s["risk"], 3).alias("risk_score"), h["layer"].alias("match_type"), h["errors"].alias("error_count"),
            tx.context(text, h["at"]).alias("context"), none.cast("array<string>").alias("signals"), pattern.alias("pattern"), h["matched"].alias("matched_text"),
            h["root"].alias("root"), s["base"].alias("token_score"), F.round(s["delta"], 3).alias("proximity_delta"), mult.alias("url_multiplier"),
            info["segment"].alias("url_segment"), info["is_whitelisted"].alias("is_whitelisted"), F.round(s["penalty"], 3).alias("penalty"),
            none.cast("double").alias("anomaly_score"), F.element_at(groups, h["idx"] + 1).alias("evidence_group"),
        )

    return F.transform(F.filter(F.transform(hits, score), enough), shaped)


def _extra(text: Column, alert: str, risk: Column, kind: str, signals: Column, pattern: str, matched: Column, mult: Column, segment: Column, anomaly: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(alert).alias("alert"), risk.alias("risk_score"), F.lit(kind).alias("match_type"), F.lit(0).alias("error_count"), tx.head(text).alias("context"),
        signals.alias("signals"), F.lit(pattern).alias("pattern"), matched.alias("matched_text"), none.cast("string").alias("root"), F.lit(0.0).alias("token_score"),
        F.lit(0.0).alias("proximity_delta"), mult.alias("url_multiplier"), segment.alias("url_segment"), F.lit(False).alias("is_whitelisted"), F.lit(0.0).alias("penalty"),
        anomaly.alias("anomaly_score"), none.cast("string").alias("evidence_group"),
    )


def with_detections(df: DataFrame, cfg: c.EngineConfig, resolutions: DataFrame | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """``df`` with ``url_info``, ``anomaly``, ``detections`` and what follows from them; a null text counts as empty."""
    own = "_text"
    df = df.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    if resolutions is None:
        return scored(df, cfg, own)
    df = with_known(held(df, _urls=tx.urls(F.col(own))), cfg, resolutions, key).drop("_urls")
    return scored(df, cfg, own, "_known").drop("_known")


def with_detections_by_columns(df: DataFrame, cfg: c.EngineConfig, resolutions: DataFrame | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """The same as columns, for the check."""
    own = "_text"
    df = with_hits(df.withColumn(own, F.coalesce(F.col(text), F.lit(""))), cfg, own)
    df = with_url_info(df, cfg, resolutions, key, own)
    t, info = F.col(own), F.col("url_info")
    df = held(df, _found=detections(t, F.col("hits"), F.col("terms"), info, cfg), anomaly=tx.anomaly(t))
    a = F.col("anomaly")
    none_d = F.lit(None).cast("double")
    fallback = F.when(
        (F.size("_found") == 0) & (a["score"] >= cfg.anomaly_threshold),
        F.array(_extra(t, "SUSPICIOUS: no known pattern matched, but the message contains phishing-like signals.", F.round(F.lit(0.95) + a["score"] * 0.4, 3), "anomaly", a["signals"], "ANOMALY_HEURISTIC", F.array_join(a["signals"], ", "), F.lit(1.0), F.lit("none"), a["score"])),
    ).otherwise(F.array())
    short = (info["segment"] == "shortener") & ~info["is_whitelisted"]
    link = (
        F.when(short, F.array(_extra(t, "CRITICAL: Unverified shortened URL detected!", F.lit(2.5), "url_shortener", F.array(F.lit("unverified shortened URL")), "UNVERIFIED_SHORTENER", F.coalesce(info["expanded_url"], F.substring(t, 1, 120)), F.lit(2.5), F.lit("shortener"), none_d)))
        .when(info["destination_risky"], F.array(_extra(t, "CRITICAL: Shortened link leads to a risky destination!", info["multiplier"], "url_shortener", F.array(F.lit("risky shortened-link destination")), "SHORTENED_LINK_DESTINATION", F.coalesce(info["expanded_url"], F.lit("")), info["multiplier"], info["segment"], none_d)))
        .otherwise(F.array())
    )
    df = held(df, detections=F.concat("_found", fallback, link), n_layer_hits=F.size("_found")).drop("_found", "hits", "terms")
    found = F.col("detections")
    return held(df, global_risk=F.coalesce(F.array_max(F.transform(found, lambda d: d["risk_score"])), F.lit(0.0)), evidence_groups=evidence(t, found, info))


def tier(risk: Column, flagged: Column, cfg: c.EngineConfig) -> tuple[Column, Column]:
    """``(severity, action tier)``."""
    low, mid, high = cfg.cutoffs
    severity = F.when(~flagged, "none").when(risk >= high, "critical").when(risk >= mid, "high").when(risk >= low, "moderate").otherwise("low")
    number = F.when(~flagged, 0).when(risk >= mid, 3).when(risk >= low, 2).otherwise(1)
    return severity, number


def evidence(text: Column, found: Column, info: Column) -> Column:
    """Sorted groups of evidence; none without detections."""
    signal = F.create_map(*[F.lit(x) for kv in c.EVIDENCE_OF_SIGNAL.items() for x in kv])
    risky = lambda segment, white: segment.isin(*c.RISKY_SEGMENTS) & ~white
    groups = F.concat(
        F.transform(found, lambda d: d["evidence_group"]),
        F.flatten(F.transform(found, lambda d: F.transform(F.coalesce(d["signals"], F.array().cast("array<string>")), lambda s: F.try_element_at(signal, s)))),
        F.transform(found, lambda d: F.when(d["match_type"] == "fuzzy", "obfuscation")),
        F.transform(found, lambda d: F.when(risky(d["url_segment"], d["is_whitelisted"]), "url_risk")),
        F.array(F.when(tx.obfuscated(text), "obfuscation"), F.when(risky(info["segment"], info["is_whitelisted"]), "url_risk")),
    )
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(groups, lambda g: g.isNotNull()))))


def gate(df: DataFrame, warning: Column, least: Column) -> DataFrame:
    """``severity``, ``action_tier`` and ``gate_passed`` from the raw ones; no message is scanned again."""
    passed = (least <= 0) | ((F.col("global_risk") >= warning) & (F.col("evidence_count") >= least))
    held = (F.col("raw_action_tier") >= 2) & ~passed
    return df.withColumn("gate_passed", passed).withColumn("severity", F.when(held, "low").otherwise(F.col("raw_severity"))).withColumn("action_tier", F.when(held, 1).otherwise(F.col("raw_action_tier")))


def assess(df: DataFrame, cfg: c.EngineConfig | None = None, resolutions: DataFrame | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """``df`` with its assessment.

    Null texts are assessed as empty ones (clean, tier 0); repeated rows each; an
    empty table gives no rows; other columns are carried, those named like a result
    column are replaced.  With ``resolutions``, ``key`` must be unique.
    """
    cfg = cfg or c.EngineConfig()
    df = with_detections(df, cfg, resolutions, key, text)
    found = F.col("detections")
    severity, number = tier(F.col("global_risk"), F.size(found) > 0, cfg)
    df = held(df, raw_severity=severity, raw_action_tier=number, evidence_count=F.size("evidence_groups"))
    df = gate(df, F.lit(cfg.warning_threshold), F.lit(cfg.min_evidence))
    return df.withColumn("is_clean", F.size(found) == 0).drop("_text")


def display_mode(number: Column, groups: Column, tier2_min: int = 2, allow_single: tuple[str, ...] = (), banner_min: int = 2) -> Column:
    """silent, collapsed or banner; a missing list of groups counts as very many."""
    n = F.when(groups.isNull(), 99).otherwise(F.size(groups))
    single = (n == 1) & F.coalesce(F.try_element_at(groups, F.lit(1)).isin(*allow_single), F.lit(False)) if allow_single else F.lit(False)
    second = F.when((n >= tier2_min) | single, "collapsed").otherwise("silent")
    only_link = (n == 1) & F.coalesce(F.try_element_at(groups, F.lit(1)) == "url_risk", F.lit(False))
    return F.when(number <= 1, "silent").when(number == 2, second).when(only_link, "collapsed").when(n >= banner_min, "banner").otherwise(second)


def pattern_summary(found: Column) -> Column:
    """The quoted patterns of the alerts, each once, in order."""
    names = F.filter(F.transform(found, lambda d: F.try_element_at(F.split(d["alert"], "'"), F.lit(2))), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(F.array_distinct(names), ", ")).otherwise("suspicious content")


def reason_text(groups: Column) -> Column:
    told = F.create_map(*[F.lit(x) for kv in c.REASONS.items() for x in kv])
    known = F.filter(F.transform(groups, lambda g: F.try_element_at(told, g)), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("contains wording often used in phishing")


def scan_tokens(found: Column) -> Column:
    token = F.transform(found, lambda d: F.when(F.coalesce(d["matched_text"], F.lit("")) != "", d["matched_text"]).otherwise(d["pattern"]))
    return F.array_distinct(F.filter(token, lambda x: F.coalesce(x, F.lit("")) != ""))
