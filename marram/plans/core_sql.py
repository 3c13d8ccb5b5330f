"""DuckDB statements that give what the core queries give, over the same tables."""

from __future__ import annotations

from marram.functions import vocab as V

_C = "event_id, report_id, segment_index, event_type, location_text, resolved_location, people_affected, severity, time_reference, description, verification_state, independent_source_count, evidence_confidence, created_at"
_R = "report_id, ingested_at, source_type, source_language, raw_text, location_hint, reporter_id, processed, suspected_injection, text_hash"


def _claims(columns: str = _C) -> str:
    return f"(SELECT DISTINCT {columns} FROM claims WHERE event_id IS NOT NULL)"


def _reports(columns: str = _R) -> str:
    return f"(SELECT DISTINCT {columns} FROM reports WHERE report_id IS NOT NULL)"


_LINKS = "(SELECT DISTINCT link_id, event_id, report_id, field_path, reason FROM evidence_links WHERE link_id IS NOT NULL)"


#: Full-width forms of the printable characters and what they stand for.
_WIDE, _PLAIN = ("".join(map(chr, range(a, a + 94))) for a in (0xFF01, 0x21))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _key(x: str) -> str:
    return rf"coalesce(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+', ' ', 'g')), '')"


def _name(x: str) -> str:
    low = rf"regexp_replace(lower({_strip(x)}), '^(?:ال|أل|الـ)\s*', '')"
    return rf"coalesce(trim(regexp_replace({low}, '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+', ' ', 'g')), '')"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(lower(translate({x}, {_q(V.DIGITS[0])}, {_q(V.DIGITS[1])})), '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+', ' ', 'g'))"


def _parts(x: str) -> str:
    cut = rf"regexp_split_to_array(regexp_replace({x}, '([.!?؟。；])\s+', '\1' || chr(31), 'g'), chr(31) || '|\n+')"
    return f"list_filter(list_transform({cut}, lambda s: {_strip('s')}), lambda s: s <> '')"


def _segments(x: str) -> str:
    long = f"list_filter({_parts(x)}, lambda s: length(s) >= 8)"
    return f"CASE WHEN {x} IS NULL OR {_strip(x)} = '' THEN [] WHEN len({long}) > 0 THEN {long} ELSE [{_strip(x)}] END"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _letters(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\s]+', '', 'g'), '\s+'), lambda w: w <> ''))"


def _severity(w: str) -> str:
    out = ""
    for level, marks in V.SEVERITY_MARKERS.items():
        out += f" WHEN len(list_filter(range(1, len({w}) + 1), lambda i: list_contains({_list(marks)}, {w}[i]) AND NOT list_has_any({w}[greatest(1, i - {V.NEGATION_WINDOW}):i - 1], {_list(V.NEGATION_CUES)}))) > 0 THEN '{level}'"
    return f"CASE{out} ELSE 'unknown' END"


def _clocks(x: str) -> str:
    doubled = rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_:])', '\1\1', 'g')"
    found = rf"regexp_extract_all({doubled}, '(?:^|[^\p{{L}}\p{{N}}_])((?:[01]?[0-9]|2[0-3]):[0-5][0-9])(?:$|[^\p{{L}}\p{{N}}_])', 1)"
    return f"list_sort(list_distinct(list_transform(coalesce({found}, []), lambda t: lpad(t, 5, '0'))))"


_PLACE = "coalesce(nullif(resolved_location, ''), nullif(location_text, ''))"
_TYPES = _list
_OPPOSED = sorted({t for p in V.STATUS_PAIRS.split(",") for t in p.split(":")})
_PAIRS = sorted({x for p in V.STATUS_PAIRS.split(",") for x in (p, ":".join(reversed(p.split(":"))))})

_SAID = "branch, place, known, event_type, people_affected, clock"
_CLASSES = f"""
k AS (SELECT *, array_to_string({_clocks('time_reference')}, '/') AS clock, coalesce(resolved_location, '') <> '' AS known FROM {_claims()}),
f AS (SELECT * FROM k WHERE event_type IN (SELECT unnest({_list(_OPPOSED)})) OR (event_type IN (SELECT unnest({_list(V.COUNTABLE_TYPES)})) AND people_affected IS NOT NULL) OR clock <> ''),
b AS (SELECT 'resolved' AS branch, {_key('resolved_location')} AS place, * FROM f WHERE known UNION ALL SELECT 'typed', {_key('location_text')}, * FROM f WHERE {_key('location_text')} <> ''),
c AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {_SAID}) AS n, first_value(event_id) OVER w AS fe, first_value(created_at) OVER w AS fc, first_value(report_id) OVER w AS fr, first_value(location_text) OVER w AS fl, first_value(time_reference) OVER w AS ft
  FROM b WINDOW w AS (PARTITION BY {_SAID} ORDER BY created_at, event_id))"""

#: Every pair of claims by itself, with the rule that holds for it.
_CONFLICTS = f"""{_CLASSES},
p AS (SELECT a.branch, a.place, a.event_id AS ea, b.event_id AS eb, a.event_type AS ta, b.event_type AS tb, a.people_affected AS na, b.people_affected AS nb, a.clock AS ka, b.clock AS kb, a.fe AS fea, b.fe AS feb, a.fc AS fca, b.fc AS fcb, a.fr AS fra, b.fr AS frb, a.fl AS fla, b.fl AS flb, a.ft AS fta, b.ft AS ftb,
  list_contains({_list(_PAIRS)}, a.event_type || ':' || b.event_type) AS opposed, a.clock <> '' AND b.clock <> '' AS timed,
  a.event_type IN (SELECT unnest({_list(V.VOLATILE_TYPES)})) AND b.event_type IN (SELECT unnest({_list(V.VOLATILE_TYPES)})) AS volatile, a.event_type = b.event_type AND a.event_type IN (SELECT unnest({_list(V.COUNTABLE_TYPES)})) AND a.people_affected <> b.people_affected AS differ
  FROM c a JOIN c b ON a.branch = b.branch AND a.place = b.place AND (a.branch = 'resolved' OR NOT (a.known AND b.known)) AND (a.created_at, a.event_id) < (b.created_at, b.event_id)),
w AS (SELECT *, CASE WHEN opposed AND volatile AND timed AND kb[1:5] > ka[1:5] THEN 'status_pair_with_temporal_order' WHEN opposed THEN 'status_pair_same_location' WHEN differ THEN 'count_mismatch_same_event' WHEN ta = tb AND timed AND ka <> kb THEN 'clock_time_mismatch' END AS rule,
  NOT coalesce(opposed AND volatile AND timed AND ka[1:5] <> kb[1:5], false) AND (fcb, feb) < (fca, fea) AS turn FROM p)"""

_CONF = "CASE WHEN sources <= 0 THEN 0.0::DOUBLE ELSE round(least(0.97::DOUBLE, least(1.0::DOUBLE, 1.6::DOUBLE * ln(1.0::DOUBLE + sources) / ln(5.0::DOUBLE)) * (1.0::DOUBLE + 0.08::DOUBLE * (languages - 1)) * weight), 3) END"
_GROUPS = f"""r AS (SELECT report_id, reporter_id, sha256(raw_text) AS h, source_language, suspected_injection AS f FROM {_reports('report_id, reporter_id, raw_text, source_language, suspected_injection')}),
j AS (SELECT k.event_type, k.report_id AS of, k.verification_state, {_key(_PLACE)} AS place, r.*, NOT coalesce(f, false) AS clean FROM {_claims()} k LEFT JOIN r ON r.report_id = k.report_id WHERE verification_state <> 'rejected'),
g AS (SELECT event_type, place, count(*) AS claims, count(DISTINCT CASE WHEN clean THEN CASE WHEN h IS NULL THEN 'report:' || coalesce(of, '') WHEN reporter_id <> '' THEN 'reporter:' || reporter_id ELSE 'anon:' || h[1:16] END END) AS sources, count(DISTINCT CASE WHEN clean THEN source_language END) AS l,
  coalesce(avg(CASE WHEN clean AND h IS NOT NULL THEN CASE WHEN coalesce(reporter_id, '') = '' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END END), 1.0::DOUBLE) AS weight, bool_or(clean AND verification_state = 'disputed') AS disputed FROM j WHERE place <> '' GROUP BY 1, 2),
s AS (SELECT *, greatest(l, 1) AS languages FROM g), t AS (SELECT *, {_CONF} AS x FROM s)"""

_CANONICAL = f"""m AS (SELECT location_text AS mention, min(row(created_at, event_id)) AS since, any_value({_name('location_text')}) AS key FROM {_claims()} WHERE list_contains({_list(V.PLACE_TYPES)}, event_type) AND location_text <> '' GROUP BY 1),
g AS (SELECT {_name('name')} AS key, min(group_id) AS group_id FROM gazetteer WHERE name IS NOT NULL GROUP BY 1),
u AS (SELECT m.*, coalesce('g:' || group_id, 'k:' || m.key) AS unit, m.key = '' OR list_contains({_list(V.GENERIC_PLACES)}, m.key) AS generic FROM m LEFT JOIN g USING (key)),
o AS (SELECT *, first_value(mention) OVER w AS fm, first_value(key) OVER w AS fk FROM u WHERE NOT generic WINDOW w AS (PARTITION BY unit ORDER BY since, mention)),
z AS (SELECT mention, key, fm, fk, false AS generic FROM o UNION ALL SELECT mention, key, NULL, NULL, true FROM u WHERE generic),
q AS (SELECT *, CASE WHEN generic THEN 'generic_or_empty' WHEN mention = fm THEN 'first_mention' WHEN key = fk THEN 'exact_normalized_match' ELSE 'known_alias' END AS reason FROM z),
names AS (SELECT mention, coalesce(fm, mention) AS canonical, CASE WHEN reason IN ('exact_normalized_match', 'known_alias') THEN true END AS same, CASE WHEN generic THEN 0.0::DOUBLE WHEN reason = 'known_alias' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence, reason FROM q)"""

_ROW = "created_at, event_id"


def statements() -> dict[str, str]:
    c, r = _claims, _reports
    rank = lambda x: f"list_position({_list(V.SEVERITIES)}, {x})"
    signals = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(raw_text, {_q('(?i)' + p)}) THEN {_q(p)} END" for p in V.INJECTION_PATTERNS) + "], lambda x: x IS NOT NULL)"
    anyp = _q("(?i)" + "|".join(f"(?:{p})" for p in V.INJECTION_PATTERNS))
    kept = f"list_filter({_parts('raw_text')}, lambda s: NOT regexp_matches(s, {anyp}))"
    place = "lower(trim(location_text))"
    edges = f"""
SELECT 'event:' || event_id AS src, 'report:' || report_id AS dst, 'reported_by' AS rel FROM {c('event_id, report_id')} WHERE report_id IS NOT NULL
UNION SELECT 'event:' || event_id, 'place:' || {place}, 'occurred_at' FROM {c('event_id, location_text')} WHERE {place} <> ''
UNION SELECT 'event:' || event_id, 'people:' || people_affected, 'affects' FROM {c('event_id, people_affected')} WHERE people_affected > 0
UNION SELECT 'event:' || event_a_id, 'event:' || event_b_id, 'contradicts' FROM conflicts WHERE event_a_id IN (SELECT event_id FROM claims) AND event_b_id IN (SELECT event_id FROM claims)
UNION SELECT 'event:' || event_id, 'event:' || nxt, 'corroborates' FROM (SELECT event_id, report_id, lead(event_id) OVER w AS nxt, lead(report_id) OVER w AS other FROM {c('event_id, report_id, event_type, location_text, created_at')}
  WHERE {place} <> '' WINDOW w AS (PARTITION BY event_type, {place} ORDER BY created_at, event_id)) WHERE nxt IS NOT NULL AND report_id <> other"""
    nodes = f"""SELECT DISTINCT 'report:' || report_id AS id, 'report' AS kind, report_id AS label FROM {r('report_id')} UNION SELECT 'event:' || event_id, 'event', replace(event_type, '_', ' ') FROM {c('event_id, event_type')}
UNION SELECT 'place:' || {place}, 'place', {place} FROM {c('event_id, location_text')} WHERE {place} <> '' UNION SELECT 'people:' || people_affected, 'people', people_affected::VARCHAR FROM {c('event_id, people_affected')} WHERE people_affected > 0"""
    tok = lambda x: rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
    tri = "CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END"
    words = lambda n: f"list_distinct(list_filter(string_split({n}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_list(V.PLACE_STOPWORDS)}, w)))"
    rich = "row((p <> '')::INT, (people_affected IS NOT NULL)::INT, (time_reference IS NOT NULL)::INT, -segment_index, event_id)"
    folded = r"trim(regexp_replace(lower(location_text), '\s+', ' ', 'g'))"
    extracted = f"""WITH r AS (SELECT report_id, suspected_injection, CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {_strip('raw_text')} END AS raw_text FROM {r('report_id, raw_text, suspected_injection')}),
s AS (SELECT report_id, suspected_injection, unnest(range(len(s)))::INT AS segment_index, unnest(s) AS segment FROM (SELECT *, {_segments('raw_text')} AS s FROM r)),
e AS (SELECT *, list_filter(regexp_split_to_array(trim(segment), '\\s+'), lambda w: regexp_full_match(w, '[0-9]{{1,8}}'))[1] AS said, {_words('segment')} AS w FROM s),
g AS (SELECT *, {_severity('w')} AS licensed, CASE WHEN said::BIGINT > 0 AND list_contains(regexp_extract_all(segment, '\\p{{Nd}}+'), CAST(said::BIGINT AS VARCHAR)) THEN said::INT END AS people FROM e)
SELECT report_id, segment_index, CASE WHEN contains(segment, 'hurt') OR contains(segment, 'bless') THEN 'injury' ELSE 'other' END AS event_type, people AS people_affected,
  CASE WHEN suspected_injection OR licensed = 'unknown' THEN 'unknown' WHEN {rank("'high'")} <= {rank('licensed')} THEN 'high' ELSE licensed END AS severity,
  concat_ws('|', CASE WHEN said::BIGINT <= 0 THEN 'people_nonpositive->null' END, CASE WHEN said::BIGINT > 0 AND people IS NULL THEN 'people_not_in_source->null' END, CASE WHEN suspected_injection THEN 'injection_flagged->severity_forced_unknown' WHEN licensed = 'unknown' THEN 'severity_unlicensed(high)->unknown' END) AS guards FROM g"""
    return {
        "conflict_classes": f"WITH {_CLASSES} SELECT branch, place, known, event_type, people_affected, clock, event_id AS first_event_id, n FROM c WHERE rn = 1",
        "conflicts_detected": f"""WITH {_CONFLICTS},
x AS (SELECT branch, place, rule, abs(na - nb) AS delta, CASE WHEN turn THEN feb ELSE fea END AS event_a_id, CASE WHEN turn THEN fea ELSE feb END AS event_b_id, CASE WHEN turn THEN frb ELSE fra END AS ra, CASE WHEN turn THEN fra ELSE frb END AS rb,
  CASE WHEN turn THEN tb ELSE ta END AS ta, CASE WHEN turn THEN ta ELSE tb END AS tb, CASE WHEN turn THEN nb ELSE na END AS na, CASE WHEN turn THEN na ELSE nb END AS nb, CASE WHEN turn THEN kb ELSE ka END AS ka, CASE WHEN turn THEN ka ELSE kb END AS kb,
  chr(39) || coalesce(nullif(CASE WHEN turn THEN flb ELSE fla END, ''), 'this place') || chr(39) AS spot, CASE WHEN turn THEN ftb ELSE fta END AS wa, CASE WHEN turn THEN fta ELSE ftb END AS wb FROM w WHERE rule IS NOT NULL)
SELECT branch, place, event_a_id, event_b_id, CASE WHEN rule LIKE 'status%' THEN 'status' WHEN rule LIKE 'count%' THEN 'numeric' ELSE 'temporal' END AS conflict_type,
  CASE WHEN rule = 'status_pair_with_temporal_order' THEN 'low' WHEN rule = 'status_pair_same_location' OR rule LIKE 'count%' AND delta > 2 THEN 'high' ELSE 'medium' END AS severity, rule, count(*) AS pairs,
  array_to_string(list_sort(list_distinct([ra, rb])), '|') AS evidence,
  '[detected by rule: ' || rule || '] ' || CASE WHEN rule = 'status_pair_with_temporal_order' THEN spot || ' is ' || ta || ' at ' || coalesce(nullif(wa, ''), 'an earlier time') || ' and ' || tb || ' at ' || coalesce(nullif(wb, ''), 'a later time') || '; its state may have changed, a person has to look'
    WHEN rule = 'status_pair_same_location' THEN spot || ' is ' || ta || ' by one report and ' || tb || ' by another; neither is preferred'
    WHEN rule LIKE 'count%' THEN 'people affected by ' || ta || ' at ' || spot || ': ' || na || ' or ' || nb || '; no value is preferred'
    ELSE ta || ' at ' || spot || ' took place at ' || ka || ' or at ' || kb || '; both times are kept' END AS explanation
FROM x GROUP BY ALL""",
        "claims_disputed": f"""WITH {_CONFLICTS}, hit AS (SELECT ea AS event_id FROM w WHERE rule IS NOT NULL UNION SELECT eb FROM w WHERE rule IS NOT NULL)
SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM hit) AND verification_state <> 'rejected' THEN 'disputed' ELSE verification_state END AS verification_state FROM {c('event_id, verification_state')}""",
        "conflict_sides": f"""WITH s AS (SELECT conflict_id, 'a' AS side, event_a_id AS event_id FROM conflicts UNION ALL SELECT conflict_id, 'b', event_b_id FROM conflicts)
SELECT s.conflict_id, s.side, s.event_id, k.report_id, r.source_language, concat_ws(', ', 'type ' || k.event_type, 'at ' || {_PLACE}, 'people ' || k.people_affected, CASE WHEN k.severity <> 'unknown' THEN 'severity ' || k.severity END, 'time ' || nullif(k.time_reference, '')) AS description
FROM s LEFT JOIN {c()} k ON k.event_id = s.event_id LEFT JOIN {r('report_id, source_language')} r ON r.report_id = k.report_id""",
        "conflicts_fresh": """WITH n AS (SELECT event_b_id AS event_a_id, event_a_id AS event_b_id, CASE WHEN status = 'dismissed' THEN 'location' ELSE conflict_type END AS conflict_type FROM conflicts)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM conflicts s WHERE least(s.event_a_id, s.event_b_id) = least(n.event_a_id, n.event_b_id) AND greatest(s.event_a_id, s.event_b_id) = greatest(n.event_a_id, n.event_b_id) AND s.conflict_type = n.conflict_type)""",
        "conflicts_by_status": "SELECT conflict_id, conflict_type, severity, strftime(detected_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS detected FROM conflicts WHERE status = 'unresolved'",
        "reports_listed": f"SELECT report_id, source_language, strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ingested FROM {r('report_id, ingested_at, source_language, processed, suspected_injection')} WHERE source_language = 'fr' AND processed AND NOT suspected_injection ORDER BY ingested_at DESC, report_id LIMIT 200",
        "claims_listed": f"SELECT event_id, event_type, location_text FROM {c('event_id, event_type, severity, location_text, created_at')} WHERE severity = 'high' AND location_text ILIKE '%kelghadou%' ORDER BY created_at DESC, event_id LIMIT 500",
        "reports_pending": f"SELECT report_id FROM {r('report_id, processed, ingested_at')} WHERE NOT processed ORDER BY ingested_at, report_id LIMIT 500",
        "report_by_id": f"SELECT * FROM {r('report_id, source_type, source_language')} WHERE report_id = (SELECT min(report_id) FROM reports)",
        "audit_of_entity": "SELECT audit_id, entity_id, action, strftime(logged_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS logged FROM audit_log WHERE entity_id = (SELECT min(entity_id) FROM audit_log WHERE action = 'report_restored')",
        "audit_recent": "SELECT audit_id, action FROM audit_log ORDER BY logged_at DESC, audit_id LIMIT 100",
        "audit_appended": f"SELECT 'ALOG-' || upper(sha256('ingested|' || report_id)[1:10]) AS audit_id, report_id AS entity_id, 'ingested' AS action FROM {r('report_id, ingested_at')}",
        "ingest_checked": f"""SELECT report_id, sha256(raw_text) AS text_hash, coalesce(nullif(lower(trim(source_language))[1:8], ''), 'und') AS language, array_to_string({signals}, '|') AS signals, len({signals}) > 0 AS suspected_injection, len({_segments('raw_text')})::INT AS segment_count,
CASE WHEN raw_text IS NULL OR {_strip('raw_text')} = '' THEN 'blank text' WHEN length(raw_text) > 8000 THEN 'text too long' WHEN coalesce(source_type, 'human_report') NOT IN ('human_report', 'batch', 'demo', 'audio_transcript') THEN 'unknown source type'
WHEN length(location_hint) > 400 THEN 'hint too long' WHEN length(reporter_id) > 64 THEN 'reporter too long' END AS reject_reason FROM {r('report_id, raw_text, source_language, source_type, location_hint, reporter_id')}""",
        "ingest_new": "SELECT DISTINCT report_id FROM reports WHERE report_id IS NOT NULL AND report_id NOT IN (SELECT report_id FROM reports WHERE processed AND report_id IS NOT NULL)",
        "ingest_hash_check": f"SELECT report_id, CASE WHEN text_hash IS NULL THEN 'missing' ELSE 'wrong' END AS problem, sha256(raw_text) AS text_hash FROM {r('report_id, raw_text, text_hash')} WHERE text_hash IS NULL OR text_hash <> sha256(raw_text)",
        "segments_of_reports": f"SELECT report_id, unnest(range(len(s)))::INT AS segment_index, unnest(s) AS segment FROM (SELECT report_id, {_segments('raw_text')} AS s FROM {r('report_id, raw_text')})",
        "text_model_view": f"SELECT report_id, CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {_strip('raw_text')} END AS view FROM {r('report_id, raw_text')}",
        "text_severity": f"SELECT report_id, {_severity('w')} AS severity FROM (SELECT report_id, {_words('raw_text')} AS w FROM {r('report_id, raw_text')})",
        "text_normal": f"SELECT report_id, {_normal('raw_text')} AS form FROM {r('report_id, raw_text')}",
        "text_fingerprints": f"SELECT report_id, sha256(array_to_string(list_sort(list_transform({_segments('raw_text')}, lambda s: {_normal('s')})), ' || ')) AS fingerprint FROM {r('report_id, raw_text')}",
        "text_clocks": f"SELECT report_id, array_to_string(k, '/') AS clocks, (k[1][1:2]::INT * 60 + k[1][4:5]::INT) AS first_minute FROM (SELECT report_id, {_clocks('raw_text')} AS k FROM {r('report_id, raw_text')}) WHERE len(k) > 0",
        "text_words": f"SELECT report_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM (SELECT report_id, {_words('raw_text')} AS w FROM {r('report_id, raw_text')})",
        "text_wire": f"SELECT event_id, event_type, location_text, people_affected, severity, time_reference FROM {c('event_id, event_type, location_text, people_affected, severity, time_reference')}",
        "guard_counts": rf"SELECT event_id, CASE WHEN people_affected > 0 AND list_contains(regexp_extract_all(raw_text, '\p{{Nd}}+'), CAST(people_affected AS VARCHAR)) THEN people_affected END AS people FROM {c('event_id, report_id, people_affected')} JOIN {r()} USING (report_id) WHERE people_affected IS NOT NULL",
        "guard_severity": f"""WITH j AS (SELECT event_id, severity, suspected_injection, {_words('raw_text')} AS w FROM {c('event_id, report_id, severity')} JOIN {r('report_id, raw_text, suspected_injection')} USING (report_id)), l AS (SELECT *, {_severity('w')} AS licensed FROM j)
SELECT event_id, CASE WHEN coalesce(suspected_injection, false) OR licensed = 'unknown' THEN 'unknown' WHEN severity IN ('low', 'medium', 'high', 'critical') AND {rank('severity')} <= {rank('licensed')} THEN severity ELSE licensed END AS severity FROM l""",
        "guard_places": f"""WITH p AS (SELECT event_id, CASE WHEN NOT list_contains({_list(V.PLACEHOLDERS)}, {folded}) THEN {_strip('location_text')} END AS place FROM {c('event_id, location_text')})
SELECT event_id, CASE WHEN NOT (list_contains({_list(V.ECHOES)}, place) OR list_contains({_list(V.ECHOES)}, lower(place)) OR contains(place, 'UNTRUSTED_REPORT')) THEN place END AS place FROM p""",
        "guard_types": f"SELECT event_id, CASE WHEN list_contains({_list(V.EVENT_TYPES)}, event_type) THEN event_type ELSE 'other' END AS event_type FROM {c('event_id, event_type')}",
        "guard_uncertainties": f"SELECT event_id, concat_ws('; ', CASE WHEN people_affected IS NULL THEN 'no people count stated in report' END, CASE WHEN severity = 'unknown' THEN 'severity not stated in report' END, CASE WHEN coalesce(location_text, '') = '' THEN 'no location stated in report' END, CASE WHEN coalesce(time_reference, '') = '' THEN 'no time reference stated in report' END) AS notes FROM {c('event_id, people_affected, severity, location_text, time_reference')}",
        "links_unpivoted": " UNION ALL ".join(f"SELECT event_id, report_id, '{f}' AS field_path, CAST({f} AS VARCHAR) AS value FROM {c()} WHERE {f} IS NOT NULL" for f in V.FIELDS),
        "links_ungrounded": f"SELECT event_id FROM {c('event_id, report_id')} k WHERE NOT EXISTS (SELECT 1 FROM evidence_links l WHERE l.event_id = k.event_id AND l.report_id = k.report_id)",
        "links_reports_per_claim": f"SELECT event_id, count(DISTINCT report_id) AS reports, count(*) AS links FROM {_LINKS} WHERE event_id IS NOT NULL GROUP BY 1",
        "claims_with_reports": f"SELECT event_id, k.report_id, event_type, reporter_id, source_language, suspected_injection FROM {c('event_id, report_id, event_type')} k LEFT JOIN {r('report_id, reporter_id, source_language, suspected_injection')} r ON r.report_id = k.report_id",
        "duplicates_exact": f"SELECT 'DUP-' || upper(text_hash[1:10]) AS group_id, count(*) AS members, first(report_id ORDER BY ingested_at, report_id) AS first_report_id, last(report_id ORDER BY ingested_at, report_id) AS last_report_id, 'exact_fingerprint' AS method, 1.0::DOUBLE AS similarity FROM {r('report_id, ingested_at, text_hash')} WHERE text_hash IS NOT NULL GROUP BY text_hash HAVING count(*) > 1",
        "duplicates_members": f"SELECT report_id, 'DUP-' || upper(text_hash[1:10]) AS group_id FROM {r('report_id, text_hash')} WHERE text_hash IN (SELECT text_hash FROM {r('report_id, text_hash')} WHERE text_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
        "duplicates_names": f"""WITH v AS (SELECT DISTINCT {_normal('name')} AS value FROM gazetteer WHERE name IS NOT NULL), t AS (SELECT value, replace(value, ' ', '_') AS t FROM v WHERE value <> ''), g AS (SELECT value, {tri} AS g FROM t),
p AS (SELECT a.value AS a, b.value AS b, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE AS s FROM g a JOIN g b ON a.value < b.value) SELECT a, b, round(s, 6) AS similarity FROM p WHERE round(s, 6) >= 0.72""",
        "score_shapes": f"""WITH {_CONFLICTS}, kc AS (SELECT *, lower(trim(coalesce({_PLACE}, ''))) AS spot FROM {c()}),
d AS (SELECT DISTINCT a.report_id AS ra, b.report_id AS rb FROM conflicts x JOIN kc a ON a.event_id = x.event_a_id JOIN kc b ON b.event_id = x.event_b_id),
s AS (SELECT CASE WHEN a.spot <> '' AND b.spot <> '' AND a.spot <> b.spot THEN ['different-place', a.event_type, b.event_type, ''] ELSE ['', least(a.event_type, b.event_type), greatest(a.event_type, b.event_type), CASE WHEN a.spot <> '' THEN a.spot ELSE b.spot END] END AS s, a.spot <> '' AND a.spot = b.spot AS comparable
  FROM d JOIN kc a ON a.report_id = d.ra JOIN kc b ON b.report_id = d.rb WHERE NOT (a.event_type = b.event_type AND a.people_affected IS NOT DISTINCT FROM b.people_affected)),
fc AS (SELECT DISTINCT CASE WHEN a.spot <> '' AND b.spot <> '' AND a.spot <> b.spot THEN ['different-place', a.event_type, b.event_type, ''] ELSE ['', least(a.event_type, b.event_type), greatest(a.event_type, b.event_type), CASE WHEN a.spot <> '' THEN a.spot ELSE b.spot END] END AS s
  FROM (SELECT DISTINCT CASE WHEN turn THEN feb ELSE fea END AS x, CASE WHEN turn THEN fea ELSE feb END AS y FROM w WHERE rule IS NOT NULL) JOIN kc a ON a.event_id = x JOIN kc b ON b.event_id = y)
SELECT s[1] AS kind, s[2] AS first_type, s[3] AS second_type, s[4] AS place, max(comparable) AS comparable, s IN (SELECT s FROM fc) AS detected FROM s GROUP BY s""",
        "score_locations": f"""WITH g AS (SELECT name, min(group_id) AS group_id FROM gazetteer WHERE name IS NOT NULL GROUP BY 1), b AS (SELECT group_id, min(name) AS want FROM gazetteer WHERE preferred AND name IS NOT NULL GROUP BY 1),
t AS (SELECT k.event_id, {_letters('want')} AS e, {_letters('k.location_text')} AS t, list_distinct(list_filter(string_split_regex(regexp_replace(lower(trim(k.resolved_location)), '[_-]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS r, trim(k.resolved_location) <> '' AS has
  FROM {c('event_id, location_text, resolved_location')} k JOIN g ON g.name = k.location_text JOIN b USING (group_id) WHERE k.resolved_location IS NOT NULL),
f AS (SELECT event_id, CASE WHEN len(list_intersect(e, t)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(e, t)) / (len(e) + len(t)) END AS x, CASE WHEN NOT has OR len(list_intersect(e, r)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(e, r)) / (len(e) + len(r)) END AS y FROM t)
SELECT event_id, round(CASE WHEN x >= 0.5 THEN x ELSE greatest(x, y) END, 6) AS score FROM f""",
        "duplicates_fresh": f"SELECT * FROM (SELECT 'DUP-' || upper(text_hash[1:10]) AS group_id, count(*) AS members, first(report_id ORDER BY ingested_at, report_id) AS first_report_id, last(report_id ORDER BY ingested_at, report_id) AS last_report_id, 'exact_fingerprint' AS method, 1.0::DOUBLE AS similarity FROM {r('report_id, ingested_at, text_hash')} WHERE text_hash IS NOT NULL GROUP BY text_hash HAVING count(*) > 1) WHERE group_id NOT IN (SELECT duplicate_group_id FROM claims WHERE duplicate_group_id IS NOT NULL)",
        "duplicates_claims": f"SELECT 'DUP-' || upper(text_hash[1:10]) AS group_id, report_id, event_id FROM {r('report_id, text_hash')} JOIN {c('event_id, report_id')} USING (report_id) WHERE text_hash IN (SELECT text_hash FROM {r('report_id, text_hash')} WHERE text_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
        "claims_detail": f"""WITH s AS (SELECT event_id, count(DISTINCT conflict_id) AS n, array_to_string(list_sort(list_distinct(list(conflict_type))), '|') AS kinds FROM (SELECT conflict_id, conflict_type, unnest([event_a_id, event_b_id]) AS event_id FROM conflicts) GROUP BY 1)
SELECT k.event_id, k.report_id, k.event_type, coalesce(r.source_language, 'und') AS source_language, coalesce(l.n, 0) AS links, coalesce(s.n, 0) AS conflicts, coalesce(s.kinds, '') AS conflict_types FROM {c('event_id, report_id, event_type')} k LEFT JOIN {r('report_id, source_language')} r ON r.report_id = k.report_id
LEFT JOIN (SELECT event_id, count(*) AS n FROM {_LINKS} GROUP BY 1) l ON l.event_id = k.event_id LEFT JOIN s ON s.event_id = k.event_id""",
        "links_report_sets": f"SELECT DISTINCT event_id, report_id FROM {_LINKS} WHERE event_id IS NOT NULL AND report_id IS NOT NULL",
        "links_moved": f"""WITH c AS (SELECT *, {_key('location_text')} AS p FROM {c()}), d AS (SELECT *, {rich} AS rich FROM c),
g AS (SELECT d.event_id AS gone, max(r.rich) AS best FROM d JOIN d r ON r.report_id = d.report_id AND r.event_type = d.event_type AND d.rich < r.rich AND (d.p = r.p OR (d.p = '') <> (r.p = '')) AND (d.people_affected IS NULL OR d.people_affected = r.people_affected) AND (d.time_reference IS NULL OR d.time_reference = r.time_reference) GROUP BY 1),
m AS (SELECT gone, x.event_id AS kept FROM g JOIN (SELECT event_id, rich, report_id FROM d) x ON x.rich = g.best)
SELECT link_id, coalesce(m.kept, l.event_id) AS event_id, report_id FROM {_LINKS} l LEFT JOIN m ON m.gone = l.event_id""",
        "claims_keys": f"SELECT event_id, {_key(_PLACE)} AS key FROM {c('event_id, resolved_location, location_text')}",
        "places_count": f"WITH {_CANONICAL} SELECT count(DISTINCT canonical) AS places FROM names",
        "metrics_latency": f"SELECT report_id, coalesce(sum(extraction_latency_ms), 0)::BIGINT AS latency_ms, count(*) AS claims FROM {c('event_id, report_id, extraction_latency_ms')} WHERE report_id IS NOT NULL GROUP BY 1",
        "metrics_pairs": f"SELECT (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM {c('event_id, report_id')}",
        "graph_colours": f"SELECT 'event:' || event_id AS id, CASE verification_state WHEN 'verified_by_operator' THEN '#22c55e' WHEN 'corroborated' THEN '#22c55e' WHEN 'disputed' THEN '#f97316' WHEN 'rejected' THEN '#6b7280' ELSE '#eab308' END AS colour FROM {c('event_id, verification_state')}",
        "guard_placeholders": rf"""WITH p AS (SELECT event_id, location_text, trim(regexp_replace(lower(strip_accents(translate(location_text, {_q(_WIDE)}, {_q(_PLAIN)}))), '\s+', ' ', 'g')) AS x, trim(regexp_replace(lower(strip_accents(translate(upper(location_text), {_q(_WIDE)}, {_q(_PLAIN)}))), '\s+', ' ', 'g')) AS y FROM {c('event_id, location_text')} WHERE location_text IS NOT NULL)
SELECT event_id, CASE WHEN NOT list_contains({_list(V.PLACEHOLDERS)}, x) THEN {_strip('location_text')} END AS place, list_contains({_list(V.PLACEHOLDERS)}, y) AS dropped FROM p""",
        "corroboration": f"""WITH {_GROUPS}
SELECT event_type, place, claims, sources, l AS languages, round(weight, 6) AS weight, CASE WHEN disputed THEN least(x, 0.49::DOUBLE) ELSE x END AS confidence, disputed FROM t""",
        "claims_evaluated": f"""WITH {_GROUPS},
m AS (SELECT k.*, {_key(_PLACE)} AS place, k.report_id IN (SELECT report_id FROM r WHERE f) AS flagged FROM {c()} k),
y AS (SELECT m.*, t.sources, t.x, t.disputed AS d FROM m LEFT JOIN t ON m.verification_state <> 'rejected' AND m.place <> '' AND t.event_type = m.event_type AND t.place = m.place)
SELECT event_id, CASE WHEN flagged THEN 0 WHEN sources IS NOT NULL THEN sources::INT ELSE independent_source_count END AS independent_source_count,
  CASE WHEN flagged THEN 0.0::DOUBLE WHEN sources IS NOT NULL THEN CASE WHEN d THEN least(x, 0.49::DOUBLE) ELSE x END ELSE evidence_confidence END AS evidence_confidence,
  CASE WHEN flagged THEN CASE WHEN verification_state IN ('corroborated', 'disputed') THEN 'unverified' ELSE verification_state END WHEN sources IS NULL OR verification_state <> 'unverified' THEN verification_state WHEN d THEN 'disputed' WHEN sources >= 2 AND x >= 0.45::DOUBLE THEN 'corroborated' ELSE verification_state END AS verification_state FROM y""",
        "claims_resolved": f"""WITH {_CANONICAL}
SELECT k.event_id, CASE WHEN n.mention IS NULL THEN k.resolved_location WHEN n.canonical <> k.location_text THEN n.canonical END AS resolved_location,
  CASE WHEN n.mention IS NULL THEN k.location_confidence WHEN n.canonical <> k.location_text THEN 0.8::DOUBLE END AS location_confidence
FROM {c('event_id, event_type, location_text, resolved_location, location_confidence')} k LEFT JOIN names n ON n.mention = k.location_text AND list_contains({_list(V.PLACE_TYPES)}, k.event_type)""",
        "places_canonical": f"WITH {_CANONICAL} SELECT mention, canonical, same, confidence, reason FROM names",
        "confidence_grid": f"WITH g AS (SELECT (i % 10)::INT AS sources, (i // 10 % 4 + 1)::INT AS languages, CASE WHEN i < 40 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS weight FROM range(80) t(i)) SELECT *, {_CONF} AS confidence FROM g",
        "places_first_names": f"SELECT name_key, first(location_text ORDER BY created_at, event_id) AS canonical, count(*) AS mentions FROM (SELECT *, {_name('location_text')} AS name_key FROM {c()}) WHERE name_key <> '' AND NOT list_contains({_list(V.GENERIC_PLACES)}, name_key) AND list_contains({_list(V.PLACE_TYPES)}, event_type) GROUP BY 1",
        "places_aliases": f"SELECT DISTINCT n.name_key, g.group_id FROM (SELECT DISTINCT {_name('location_text')} AS name_key FROM claims WHERE event_id IS NOT NULL) n JOIN (SELECT DISTINCT group_id, {_name('name')} AS name_key FROM gazetteer) g USING (name_key)",
        "places_keys": f"""SELECT event_id, {_key('location_text')} AS key, n AS name, {place} AS raw, n = '' OR list_contains({_list(V.GENERIC_PLACES)}, n) AS generic, array_to_string(list_sort(list_distinct(list_filter(string_split(n, ' '), lambda w: length(w) > 1 AND NOT list_contains({_list(V.PLACE_STOPWORDS)}, w)))), ' ') AS tokens
FROM (SELECT *, {_name('location_text')} AS n FROM {c('event_id, location_text')} WHERE location_text IS NOT NULL)""",
        "places_resolution": f"""WITH m AS (SELECT DISTINCT location_text AS mention, {_name('location_text')} AS key FROM claims WHERE location_text IS NOT NULL AND event_id IS NOT NULL), k AS (SELECT DISTINCT name AS canonical, {_name('name')} AS key FROM gazetteer WHERE preferred), g AS (SELECT DISTINCT {_name('name')} AS key, group_id FROM gazetteer),
x AS (SELECT mention, min(canonical) AS exact FROM m JOIN k USING (key) GROUP BY 1), a AS (SELECT mention, min(canonical) AS alias FROM m JOIN g USING (key) JOIN (SELECT canonical, group_id FROM k JOIN g USING (key)) h USING (group_id) GROUP BY 1),
mw AS (SELECT mention, unnest({words('key')}) AS w FROM m), kw AS (SELECT canonical, unnest({words('key')}) AS w FROM k), s AS (SELECT mention, min(canonical) AS shared FROM mw JOIN kw USING (w) GROUP BY 1),
j AS (SELECT *, CASE WHEN key = '' OR list_contains({_list(V.GENERIC_PLACES)}, key) THEN 'generic_or_empty' WHEN exact IS NOT NULL THEN 'exact_normalized_match' WHEN alias IS NOT NULL THEN 'known_alias' WHEN shared IS NOT NULL THEN 'shared_content_word' ELSE 'name_is_new' END AS reason FROM m LEFT JOIN x USING (mention) LEFT JOIN a USING (mention) LEFT JOIN s USING (mention))
SELECT mention, CASE reason WHEN 'exact_normalized_match' THEN exact WHEN 'known_alias' THEN alias WHEN 'shared_content_word' THEN shared ELSE mention END AS canonical, CASE WHEN reason <> 'generic_or_empty' THEN reason <> 'name_is_new' END AS same, CASE reason WHEN 'exact_normalized_match' THEN 1.0::DOUBLE WHEN 'known_alias' THEN 0.7::DOUBLE WHEN 'shared_content_word' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence, reason FROM j""",
        "claims_collapsed": f"""WITH c AS (SELECT *, {_key('location_text')} AS p FROM {c()}), d AS (SELECT *, {rich} AS rich FROM c)
SELECT event_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d r WHERE r.report_id = d.report_id AND r.event_type = d.event_type AND d.rich < r.rich AND (d.p = r.p OR (d.p = '') <> (r.p = '')) AND (d.people_affected IS NULL OR d.people_affected = r.people_affected) AND (d.time_reference IS NULL OR d.time_reference = r.time_reference))""",
        "claims_extracted": extracted,
        "reports_processed": f"""WITH x AS ({extracted}), y AS (SELECT report_id, count(*) AS claims, 2 * count(*) + count(people_affected) AS links FROM x GROUP BY 1)
SELECT r.report_id, len({_segments('v')})::INT AS segment_count, coalesce(y.claims, 0) AS claims, coalesce(y.links, 0) AS links FROM (SELECT report_id, CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {_strip('raw_text')} END AS v FROM {r('report_id, raw_text, suspected_injection, ingested_at')}) r LEFT JOIN y ON y.report_id = r.report_id""",
        "duplicates_classified": f"""WITH t AS (SELECT report_id, {_normal('raw_text')} AS form, sha256(array_to_string(list_sort(list_transform({_segments('raw_text')}, lambda s: {_normal('s')})), ' || ')) AS p FROM {r('report_id, raw_text')}), k AS {c('event_id, report_id')},
j AS (SELECT conflict_id, replace(x.form, ' ', '_') AS t, replace(y.form, ' ', '_') AS u, x.p = y.p AS same FROM conflicts JOIN k a ON a.event_id = event_a_id JOIN k b ON b.event_id = event_b_id JOIN t x ON x.report_id = a.report_id JOIN t y ON y.report_id = b.report_id),
g AS (SELECT conflict_id, same, {tri} AS a, {tri.replace('(t)', '(u)').replace('[t]', '[u]').replace('substr(t,', 'substr(u,')} AS b FROM j), s AS (SELECT *, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS similarity FROM g)
SELECT conflict_id, similarity, CASE WHEN same THEN 'exact_fingerprint' WHEN similarity >= 0.92 THEN 'trigram_strong' WHEN similarity >= 0.72 THEN 'trigram_review' ELSE 'trigram_weak' END AS class FROM s""",
        "graph_nodes": nodes,
        "graph_edges": edges,
        "graph_stats": f"WITH x AS ({nodes}), e AS ({edges}) SELECT 'node:' || kind AS what, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'edge:' || rel, count(*) FROM e GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM x UNION ALL SELECT 'edges', count(*) FROM e",
        "metrics_summary": f"""SELECT * FROM (SELECT count(*) AS claims, count(*) FILTER (verification_state = 'unverified') AS unverified, count(*) FILTER (verification_state = 'corroborated') AS corroborated, count(*) FILTER (verification_state = 'disputed') AS disputed, count(*) FILTER (verification_state = 'verified_by_operator') AS verified,
count(*) FILTER (verification_state = 'rejected') AS rejected, count(*) FILTER (severity = 'critical') AS critical, coalesce(sum(people_affected), 0)::BIGINT AS people_reported, coalesce(sum(people_affected), 0)::BIGINT AS people_lower_bound, count(DISTINCT CASE WHEN verification_state <> 'rejected' AND trim(location_text) <> '' THEN {place} END) AS places, coalesce(max(independent_source_count), 0) AS most_sources FROM {c()}),
(SELECT count(*) AS reports, count(*) FILTER (suspected_injection) AS flagged_reports, count(*) FILTER (processed) AS processed_reports FROM {r('report_id, suspected_injection, processed')}), (SELECT count(*) FILTER (status = 'unresolved') AS unresolved_conflicts, count(*) FILTER (status <> 'unresolved') AS settled_conflicts FROM conflicts), (SELECT count(*) AS duplicate_groups FROM (SELECT text_hash FROM {r('report_id, ingested_at, text_hash')} WHERE text_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)), (SELECT 'rules' AS model_label, 'offline' AS model_used)""",
        "metrics_states": f"SELECT verification_state, count(*) AS n FROM {c('event_id, verification_state')} GROUP BY 1",
        "metrics_languages": f"SELECT source_language, count(*) AS n FROM {r('report_id, source_language')} GROUP BY 1",
    }
