"""SQL that says the same as the plans, for the comparison on another engine.

``ENGINE`` is a chain of common table expressions over ``detections`` and
``pattern_file``; each query's SQL selects from it.
"""

from siftlane import config as c

#: Shortened links of the test data, beside the usual ones.
SHORTENERS = (*c.SHORTENERS, "tny.example", "go.putol.test", "ikli.example")


def quoted(words: tuple[str, ...]) -> str:
    return ",".join(f"'{w}'" for w in words)


NORM = "translate(lower({}), '@013$45vfj', 'aoiesasbpg')"
W = r"[\p{L}\p{N}_]"
#: Text for link matching: other scripts' letters become word characters that are no ASCII letters, all blanks plain.
ASCIIED = r"array_to_string(list_transform(string_split({}, ''), lambda ch: CASE WHEN ch <= '~' THEN (CASE WHEN regexp_full_match(ch, '[\x1c-\x1f]') THEN ' ' ELSE ch END) WHEN regexp_full_match(ch, '[\p{{L}}\p{{N}}]') THEN '_' WHEN regexp_full_match(ch, '[\x{{85}}\p{{Z}}]') THEN ' ' ELSE ch END), '')"
URL = r"(?:https?://|www\.)\S+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?"
URL_LIKE = r"\b(?:https?://|www\.)\S+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?"
STRIP = r"regexp_replace({}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
OBFUSCATED = r"regexp_matches(lower({}), '(^|[^\p{{L}}\p{{N}}_])[a-z]+[0-9@$]+[a-z]+($|[^\p{{L}}\p{{N}}_])')"

SHORT = quoted(SHORTENERS)
LEGIT = quoted(c.LEGITIMATE)

DICT = """dict AS (
  SELECT row_number() OVER (ORDER BY idx) - 1 AS j, category, pattern, translate(lower(pattern), '@013$45vfj', 'aoiesasbpg') AS norm,
    CASE category WHEN 'brand' THEN 'brand_entity' WHEN 'money' THEN 'credential_payment' WHEN 'deed' THEN 'action_request' WHEN 'state' THEN 'urgency_threat' WHEN 'lure' THEN 'urgency_threat' END AS evid
  FROM (SELECT idx, category, trim(pattern) AS pattern FROM pattern_file WHERE trim(pattern) <> ''))"""

MSG = "msg AS (SELECT id, coalesce(message_text, '') AS text FROM detections), clean AS (SELECT id, text, " + NORM.format("text") + " AS clean, lower(text) AS low, length(text) AS n FROM msg)"

HITS = f"""
starts AS (SELECT id, clean, n, p FROM (SELECT id, clean, n, unnest(range(1, n + 1)) AS p FROM clean)
  WHERE p = 1 OR NOT regexp_full_match(substr(clean, p - 1, 1), '{W}')),
win AS (SELECT s.id, s.p, m.len, substr(s.clean, s.p, m.len) AS w FROM starts s, (SELECT DISTINCT length(norm) AS len FROM dict) m
  WHERE s.p + m.len - 1 <= s.n AND (s.p + m.len - 1 = s.n OR NOT regexp_full_match(substr(s.clean, s.p + m.len, 1), '{W}'))),
plain AS (SELECT id, p, len, w, regexp_replace(w, '[^\\x01-\\x7f]', chr(1), 'g') AS a FROM win),
bounded AS (SELECT id, j, p - 1 AS first, p + len - 2 AS last, w AS matched, CASE WHEN w = norm THEN 0 ELSE 1 END AS errors
  FROM plain JOIN dict ON length(norm) = len AND (w = norm OR (len >= 3 AND len <= 63 AND hamming(a, norm) <= 1))),
tok AS (SELECT id, text, n, regexp_extract_all(clean, '{W}(?:[\\p{{L}}\\p{{N}}_-]*{W})?') AS toks, string_split_regex(clean, '{W}(?:[\\p{{L}}\\p{{N}}_-]*{W})?') AS gaps FROM clean),
tok1 AS (SELECT id, toks[k] AS token, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(toks[1:k-1], lambda x: length(x))), 0) AS pos FROM tok, unnest(range(1, len(toks) + 1)) AS t(k)),
pre AS (SELECT *, replace(lower(token), '-', '') AS word FROM tok1),
cut AS (SELECT *, CASE {" ".join(f"WHEN starts_with(word, '{x}') AND length(word) > {len(x) + 2} THEN substr(word, {len(x) + 1})" for x in c.PREFIXES)} ELSE word END AS r0 FROM pre),
roots AS (SELECT DISTINCT substr(a.norm, 1, k) AS root, b.j FROM dict a, unnest(range(1, length(a.norm) + 1)) AS t(k), dict b WHERE ends_with(substr(a.norm, 1, k), b.norm)),
stems AS (SELECT *, list_filter([{", ".join(f"CASE WHEN ends_with(r0, '{x}') AND length(r0) - {len(x)} >= 4 THEN substr(r0, 1, length(r0) - {len(x)}) END" for x in c.SUFFIXES)}], lambda x: x IS NOT NULL) AS st FROM cut),
known AS (SELECT list(DISTINCT root) AS ks FROM roots),
rooted AS (SELECT id, token, pos, word, coalesce(list_filter(st, lambda x: list_contains(ks, translate(x, '@013$45vfj', 'aoiesasbpg')))[1], st[1], r0) AS root FROM stems, known),
affix AS (SELECT id, j, pos AS first, pos + length(token) - 1 AS last, token AS matched, r.root FROM rooted r JOIN roots k ON translate(r.root, '@013$45vfj', 'aoiesasbpg') = k.root WHERE r.root <> r.word),
hits AS (
  SELECT id, 'exact' AS layer, j, 0 AS errors, first, last, last AS pos, matched, CAST(NULL AS VARCHAR) AS root FROM bounded WHERE errors = 0
  UNION ALL SELECT id, 'fuzzy', j, errors, first, last, last, matched, NULL FROM bounded WHERE errors > 0
  UNION ALL SELECT id, 'affix', j, 0, first, last, first, matched, root FROM affix)"""

BOOST = quoted(c.BOOSTERS)
NEUTRAL = quoted(c.NEUTRALIZERS)

PROXIMITY = f"""
terms AS (SELECT k, [{BOOST},{NEUTRAL}][k] AS term, CASE WHEN k <= {len(c.BOOSTERS)} THEN 1.0 ELSE -2.5 END::DOUBLE AS w FROM unnest(range(1, {len(c.BOOSTERS) + len(c.NEUTRALIZERS) + 1})) AS t(k)),
hitmsg AS (SELECT id, low, n FROM clean WHERE id IN (SELECT id FROM hits)),
occ AS (SELECT id, k, w, length(term) AS size, p - 1 AS pos FROM (SELECT h.id, h.low, k, w, term, unnest(range(1, h.n - length(term) + 2)) AS p FROM hitmsg h JOIN terms ON contains(h.low, term)) WHERE substr(low, p, length(term)) = term),
delta0 AS (SELECT h.id, h.layer, h.j, h.first, h.pos, list(o.w / (abs(o.pos - h.pos) + 1) ORDER BY o.k, o.pos) AS xs
  FROM (SELECT DISTINCT id, layer, j, first, pos FROM hits) h JOIN clean c USING (id) JOIN occ o ON o.id = h.id AND o.pos >= greatest(0, h.pos - 50) AND o.pos + o.size <= least(c.n, h.pos + 50) GROUP BY ALL),
delta AS (SELECT h.*, CASE WHEN d.xs IS NULL THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_reduce(d.xs, lambda a, b: a + b))) END AS delta FROM hits h LEFT JOIN delta0 d USING (id, layer, j, first, pos))"""


def links(source: str, key: str, text: str, extra: str = "") -> str:
    """Links of ``source`` and their class; unresolved where shortened."""
    return f"""
lk AS (SELECT {key} AS id, unnest(regexp_extract_all({ASCIIED.format(text)}, '{URL}', 0, 'i')) AS url, generate_subscripts(regexp_extract_all({ASCIIED.format(text)}, '{URL}', 0, 'i'), 1) AS ord FROM {source}),
{parts('lk')},
{classes('lp')},
worst AS (SELECT id, multiplier, segment, white FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY multiplier DESC, white, ord) AS rn FROM (SELECT id, ord, CASE WHEN short THEN 'shortener' WHEN white THEN 'sld' ELSE struct END AS segment, white AND NOT short AS white,
   CASE CASE WHEN short THEN 'shortener' WHEN white THEN 'sld' ELSE struct END WHEN 'shortener' THEN 2.5 WHEN 'subdomain' THEN 2.0 WHEN 'lookalike' THEN 2.0 WHEN 'path' THEN 1.5 WHEN 'query' THEN 1.5 ELSE 1.0 END::DOUBLE AS multiplier FROM lc) WHERE segment IS NOT NULL) WHERE rn = 1){extra}"""


def parts(of: str) -> str:
    return f"""l1 AS (SELECT *, regexp_replace(url, '^https?://', '', 'i') AS r FROM {of}),
l2 AS (SELECT *, CASE WHEN contains(r, '?') THEN substr(r, instr(r, '?') + 1) ELSE '' END AS query, CASE WHEN contains(r, '?') THEN substr(r, 1, instr(r, '?') - 1) ELSE r END AS r2 FROM l1),
l3 AS (SELECT *, CASE WHEN contains(r2, '/') THEN substr(r2, instr(r2, '/') + 1) ELSE '' END AS path, string_split(regexp_replace(CASE WHEN contains(r2, '/') THEN substr(r2, 1, instr(r2, '/') - 1) ELSE r2 END, ':[0-9]{{1,5}}$', ''), '.') AS labels FROM l2),
l4 AS (SELECT *, labels[-1] AS tld, CASE WHEN len(labels) >= 2 THEN labels[-2] ELSE '' END AS sld, CASE WHEN len(labels) > 2 THEN labels[1:len(labels) - 2] ELSE [] END AS subdomains FROM l3),
l5 AS (SELECT *, list_filter(list_transform(list_concat(subdomains, [sld, tld]), lambda x: lower(x)), lambda x: x <> '') AS ls, lower(array_to_string(list_concat(subdomains, [sld, tld]), '.')) AS host FROM l4),
lp AS (SELECT *, array_to_string(CASE WHEN len(ls) >= 3 AND ls[-2] IN ('com','gov','org','edu','net') THEN ls[-3:] ELSE ls[-2:] END, '.') AS root FROM l5)"""


def classes(of: str) -> str:
    return f"""lh AS (SELECT DISTINCT host, root, subdomains, path, query, sld FROM {of}),
lr AS (SELECT host, subdomains, path, query, sld, arg_min(rank, j) AS rank FROM (SELECT h.*, j,
   CASE WHEN len(list_filter(h.subdomains, lambda s: contains(translate(lower(s), '@013$45vfj', 'aoiesasbpg'), norm))) > 0 THEN 'subdomain'
     WHEN contains(translate(lower(h.path), '@013$45vfj', 'aoiesasbpg'), norm) THEN 'path'
     WHEN contains(translate(lower(h.query), '@013$45vfj', 'aoiesasbpg'), norm) THEN 'query'
     WHEN contains(translate(lower(h.sld), '@013$45vfj', 'aoiesasbpg'), norm) THEN 'sld' END AS rank FROM lh h, dict) WHERE rank IS NOT NULL GROUP BY ALL),
lb AS (SELECT DISTINCT root FROM lh JOIN dict ON category = 'brand' AND contains(translate(lower(string_split(root, '.')[1]), '@013$45vfj', 'aoiesasbpg'), norm)),
lc AS (SELECT u.*, len(list_filter([{SHORT}], lambda s: u.host = s OR ends_with(u.host, '.' || s))) > 0 AS short, u.root IN ({LEGIT}) AS white, CASE WHEN b.root IS NOT NULL THEN 'lookalike' ELSE r.rank END AS struct
   FROM {of} u LEFT JOIN lr r ON r.host = u.host AND r.subdomains = u.subdomains AND r.path = u.path AND r.query = u.query AND r.sld = u.sld LEFT JOIN lb b ON b.root = u.root)"""


def any_of(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def anomaly(source: str, key: str, text: str) -> str:
    """``anom(id, score, signals)``."""
    steps = [
        (any_of("nm", c.URGENCY_TERMS), 0.22, "urgency language"), (any_of("nm", c.ACTION_TERMS), 0.20, "action request"), (any_of("nm", c.SENSITIVE_TERMS), 0.28, "credential or payment language"),
        (any_of("nm", c.BENIGN_TERMS), -0.18, "benign context"), (f"regexp_matches({ASCIIED.format('nm')}, '{URL_LIKE}', 'i')", 0.18, "URL-like text"),
        (OBFUSCATED.format("tx"), 0.12, "obfuscated spelling"), ("length(regexp_replace(tx, '\\P{Nd}', '', 'g'))::DOUBLE / greatest(length(tx), 1) >= 0.08", 0.08, "digit-heavy content"),
    ]
    score = "0.0::DOUBLE"
    for i, (_, amount, _) in enumerate(steps):
        moved = f"least(1.0::DOUBLE, {score} + {amount}::DOUBLE)" if amount > 0 else f"greatest(0.0::DOUBLE, {score} - {-amount}::DOUBLE)"
        score = f"(CASE WHEN s{i} THEN {moved} ELSE {score} END)"
    # each step in its own expression, so that the text does not double with every step
    chain, prev = [], "an0"
    for i, (_, amount, _) in enumerate(steps):
        moved = f"least(1.0::DOUBLE, v + {amount}::DOUBLE)" if amount > 0 else f"greatest(0.0::DOUBLE, v - {-amount}::DOUBLE)"
        chain.append(f"an{i + 1} AS (SELECT * REPLACE (CASE WHEN s{i} THEN {moved} ELSE v END AS v) FROM {prev})")
        prev = f"an{i + 1}"
    tests = ", ".join(f"{t} AS s{i}" for i, (t, _, _) in enumerate(steps))
    labels = ", ".join(f"CASE WHEN s{i} THEN '{label}' END" for i, (_, _, label) in enumerate(steps))
    return f"""an AS (SELECT {key} AS id, {text} AS tx, {NORM.format(text)} AS nm FROM {source}),
an0 AS (SELECT id, tx, 0.0::DOUBLE AS v, {tests} FROM an),
{", ".join(chain)},
anom AS (SELECT id, round(v, 3) AS score, list_filter([{labels}], lambda x: x IS NOT NULL)[1:4] AS signals FROM {prev})"""


ENGINE = f"""WITH {DICT}, {MSG}, {HITS}, {PROXIMITY},
{links('clean', 'id', 'text')},
{anomaly('clean', 'id', 'text')},
info AS (SELECT c.id, coalesce(w.multiplier, 1.0) AS mult, coalesce(w.segment, 'none') AS segment, coalesce(w.white, false) AS white FROM clean c LEFT JOIN worst w USING (id)),
scored AS (SELECT d.id, d.layer, d.j, d.errors, d.first, d.pos, d.matched, d.root, d.delta, i.mult, i.segment, i.white,
   (CASE WHEN layer = 'exact' THEN 1.25 ELSE 1.0 END::DOUBLE + delta - CASE layer WHEN 'fuzzy' THEN errors * 0.1::DOUBLE WHEN 'affix' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) * mult AS risk FROM delta d JOIN info i USING (id)),
found AS (SELECT s.*, p.pattern, p.evid, round(risk, 3) AS risk_score FROM scored s JOIN dict p USING (j)
   WHERE risk >= CASE layer WHEN 'exact' THEN 1.2::DOUBLE WHEN 'fuzzy' THEN 1.2::DOUBLE - errors * 0.15::DOUBLE ELSE 1.05::DOUBLE END),
det AS (
  SELECT id, layer AS match_type, pattern, matched AS matched_text, root, errors AS error_count, risk_score, first AS first, evid, segment AS url_segment, white AS is_whitelisted, CAST([] AS VARCHAR[]) AS signals FROM found
  UNION ALL SELECT a.id, 'anomaly', 'ANOMALY_HEURISTIC', array_to_string(signals, ', '), NULL, 0, round(0.95::DOUBLE + score * 0.4::DOUBLE, 3), 0, NULL, 'none', false, signals FROM anom a WHERE a.score >= 0.45 AND a.id NOT IN (SELECT id FROM found)
  UNION ALL SELECT id, 'url_shortener', 'UNVERIFIED_SHORTENER', NULL, NULL, 0, 2.5, 0, NULL, 'shortener', false, ['unverified shortened URL'] FROM info WHERE segment = 'shortener'),
groups AS (
  SELECT id, evid AS g FROM det WHERE evid IS NOT NULL
  UNION SELECT id, CASE s WHEN 'urgency language' THEN 'urgency_threat' WHEN 'action request' THEN 'action_request' WHEN 'credential or payment language' THEN 'credential_payment' WHEN 'obfuscated spelling' THEN 'obfuscation' END FROM (SELECT id, unnest(signals) AS s FROM det)
  UNION SELECT id, 'obfuscation' FROM det WHERE match_type = 'fuzzy'
  UNION SELECT id, 'url_risk' FROM det WHERE url_segment IN ('shortener','subdomain','path','query','lookalike') AND NOT is_whitelisted
  UNION SELECT d.id, 'obfuscation' FROM det d JOIN clean c USING (id) WHERE {OBFUSCATED.format('c.text')}
  UNION SELECT d.id, 'url_risk' FROM det d JOIN info i USING (id) WHERE i.segment IN ('shortener','subdomain','path','query','lookalike') AND NOT i.white),
assess AS (SELECT c.id, c.text, coalesce(m.risk, 0.0::DOUBLE) AS global_risk, m.id IS NULL AS is_clean, coalesce(g.gs, []) AS gs, len(coalesce(g.gs, [])) AS evidence_count,
   CASE WHEN m.id IS NULL THEN 'none' WHEN m.risk >= 2.5 THEN 'critical' WHEN m.risk >= 1.5 THEN 'high' WHEN m.risk >= 1.142 THEN 'moderate' ELSE 'low' END AS severity,
   CASE WHEN m.id IS NULL THEN 0 WHEN m.risk >= 1.5 THEN 3 WHEN m.risk >= 1.142 THEN 2 ELSE 1 END AS tier
   FROM clean c LEFT JOIN (SELECT id, max(risk_score) AS risk FROM det GROUP BY id) m USING (id) LEFT JOIN (SELECT id, list(g ORDER BY g) AS gs FROM groups WHERE g IS NOT NULL GROUP BY id) g USING (id))
"""
#: The same over the labelled messages, and with their labels.
LABELLED = ENGINE.replace("FROM detections)", "FROM labelled_csv)").replace("SELECT id, coalesce(message_text, '') AS text", "SELECT row_id AS id, coalesce(text, '') AS text").rstrip() + """,
lab AS (SELECT a.*, lower(trim(coalesce(l.label, ''))) = '1' AS y, CASE WHEN tier <= 1 THEN 'silent' WHEN tier = 2 THEN CASE WHEN evidence_count >= 2 THEN 'collapsed' ELSE 'silent' END WHEN gs = ['url_risk'] THEN 'collapsed' WHEN evidence_count >= 2 THEN 'banner' ELSE 'silent' END AS shown FROM assess a JOIN labelled_csv l ON l.row_id = a.id)
"""
