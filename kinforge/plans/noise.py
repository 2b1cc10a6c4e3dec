"""Snapshot audits, exposure, noise channels and generated corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.operators import audit, channels, exposure, generate
from kinforge.operators.audit import ABBREVIATIONS
from kinforge.plans.common import BASE, people, r6, with_sql
from kinforge.plans.registry import query
from kinforge.session import materialize

FIELDS = ["given_name", "family_name", "dob", "zip", "phone"]


def _snapshots(spark, sf_dir):
    """First record of each customer against the second one, by entity."""
    rows = people(spark, sf_dir).select(F.col("entity_id").alias("ncid"), "record_id", *FIELDS, "source")
    first = rows.where("record_id LIKE '%-0'").drop("record_id")
    later = rows.where("record_id NOT LIKE '%-0'").drop("record_id")
    return first, later


ALIGN_SQL = """later AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity_id) AS k FROM persons WHERE record_id NOT LIKE '%-0') WHERE k = 1),
aligned AS (SELECT f.entity_id AS ncid, """ + ", ".join(f"f.{c} AS {c}_a, l.{c} AS {c}_b" for c in [*FIELDS, "source"]) + """
  FROM persons f JOIN later l ON f.entity_id = l.entity_id WHERE f.record_id LIKE '%-0')"""


@query("align_pair", with_sql(*BASE, ALIGN_SQL, select="SELECT * FROM aligned"))
def align_pair(spark, sf_dir):
    return audit.align(*_snapshots(spark, sf_dir))


@query(
    "align_stats",
    with_sql(
        *BASE,
        ALIGN_SQL,
        select="""SELECT 0::BIGINT AS dup_keys_a, (SELECT count(*) FROM (SELECT entity_id FROM persons WHERE record_id NOT LIKE '%-0' GROUP BY 1 HAVING count(*) > 1)) AS dup_keys_b,
  (SELECT count(*) FROM aligned) AS n_aligned""",
    ),
)
def align_stats(spark, sf_dir):
    return audit.align_stats(*_snapshots(spark, sf_dir))


def _category_sql(f: str) -> str:
    a, b = f"{f}_a", f"{f}_b"
    swap = "false"
    if f in ("given_name", "family_name"):
        o = "family_name" if f == "given_name" else "given_name"
        swap = f"coalesce({a} = {o}_b AND {o}_a = {b} AND trim({o}_a) <> '' AND trim({o}_b) <> '', false)"
    def day(c):
        return f"coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y'), try_strptime({c}, '%Y%m%d'))"
    def skel(c):
        return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    return f"""CASE WHEN (coalesce(trim({a}), '') = '' AND coalesce(trim({b}), '') = '') OR coalesce({a} = {b}, false) THEN 'identical'
    WHEN coalesce(trim({a}), '') = '' THEN 'missing_gain' WHEN coalesce(trim({b}), '') = '' THEN 'missing_loss' WHEN {swap} THEN 'swap'
    WHEN {skel(a)} = {skel(b)} OR coalesce({day(a)} = {day(b)}, false) THEN 'format_drift'
    WHEN levenshtein(lower({a}), lower({b})) <= 2 THEN 'typo' ELSE 'wholesale' END"""


LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT ncid, source_a, '{f}' AS field, {_category_sql(f)} AS category FROM aligned" for f in FIELDS) + ")"


@query("audit_long", with_sql(*BASE, ALIGN_SQL, LONG_SQL, select="SELECT ncid, field, category FROM long"))
def audit_long(spark, sf_dir):
    return audit.classify(audit.align(*_snapshots(spark, sf_dir)), FIELDS)


Z = audit.Z95
PREV_SQL = f"""prev AS (SELECT source_a, field, category, n, total, n / total AS rate,
  greatest(0, (n / total + {Z * Z} / (2 * total) - {Z} * sqrt(n / total * (1 - n / total) / total + {Z * Z} / (4 * total * total))) / (1 + {Z * Z} / total)) AS lo,
  least(1, (n / total + {Z * Z} / (2 * total) + {Z} * sqrt(n / total * (1 - n / total) / total + {Z * Z} / (4 * total * total))) / (1 + {Z * Z} / total)) AS hi
  FROM (SELECT *, sum(n) OVER (PARTITION BY source_a, field) AS total FROM (SELECT source_a, field, category, count(*)::DOUBLE AS n FROM long GROUP BY 1, 2, 3)))"""


@query(
    "audit_prevalence",
    with_sql(
        *BASE,
        ALIGN_SQL,
        LONG_SQL,
        PREV_SQL,
        select="SELECT source_a, field, category, n::BIGINT AS n, total::BIGINT AS total, round(rate, 6) AS rate, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi FROM prev",
    ),
)
def audit_prevalence(spark, sf_dir):
    out = audit.report(audit.align(*_snapshots(spark, sf_dir)), FIELDS, by=["source_a"])
    return out.select("source_a", "field", "category", "n", "total", *[r6(c).alias(c) for c in ("rate", "lo", "hi")])


@query(
    "category_mix",
    with_sql(
        *BASE,
        ALIGN_SQL,
        LONG_SQL,
        select="SELECT field, " + ", ".join(f"round(count(*) FILTER (category = '{c}') / count(*)::DOUBLE, 6) AS {c}" for c in audit.CATEGORIES) + " FROM long GROUP BY 1",
    ),
)
def category_mix(spark, sf_dir):
    mix = audit.category_mix(audit.classify(audit.align(*_snapshots(spark, sf_dir)), FIELDS))
    return mix.select("field", *[r6(c).alias(c) for c in audit.CATEGORIES])


def _js_sql() -> str:
    m = {c: f"((g.{c} + f.{c}) / 2)" for c in audit.CATEGORIES}
    return " + ".join(f"CASE WHEN g.{c} > 0 THEN g.{c} * log2(g.{c} / {m[c]}) / 2 ELSE 0 END + CASE WHEN f.{c} > 0 THEN f.{c} * log2(f.{c} / {m[c]}) / 2 ELSE 0 END" for c in audit.CATEGORIES)


@query(
    "js_divergence",
    with_sql(
        *BASE,
        ALIGN_SQL,
        LONG_SQL,
        "mix AS (SELECT field, " + ", ".join(f"count(*) FILTER (category = '{c}') / count(*)::DOUBLE AS {c}" for c in audit.CATEGORIES) + " FROM long GROUP BY 1)",
        select=f"SELECT g.field AS field_a, f.field AS field_b, round({_js_sql()}, 6) AS js FROM mix g JOIN mix f ON g.field < f.field",
    ),
)
def js_divergence(spark, sf_dir):
    mix = materialize(audit.category_mix(audit.classify(audit.align(*_snapshots(spark, sf_dir)), FIELDS)), "mix")
    left = mix.select(F.col("field").alias("field_a"), *[F.col(c).alias(f"p_{c}") for c in audit.CATEGORIES])
    right = mix.select(F.col("field").alias("field_b"), *[F.col(c).alias(f"q_{c}") for c in audit.CATEGORIES])
    js = audit.jensen_shannon([F.col(f"p_{c}") for c in audit.CATEGORIES], [F.col(f"q_{c}") for c in audit.CATEGORIES])
    return left.join(right, F.col("field_a") < F.col("field_b")).select("field_a", "field_b", r6(js).alias("js"))  # a row a field


EXPO_SQL = """rates AS (SELECT city, avg((phone IS NULL)::INTEGER) AS rate, count(*) AS n FROM persons GROUP BY 1)
SELECT city, round(rate / (SELECT sum(rate * n) / sum(n) FROM rates), 6) AS multiplier FROM rates WHERE city IS NOT NULL"""


@query("exposure_multipliers", with_sql(*BASE, select="").rstrip() + ",\n" + EXPO_SQL)
def exposure_multipliers(spark, sf_dir):
    rates = people(spark, sf_dir).groupBy("city").agg(F.avg(F.col("phone").isNull().cast("int")).alias("rate"), F.count("*").alias("n"))
    return exposure.ExposureModel.fit(rates).table.select("city", r6("multiplier").alias("multiplier"))


def _clean(spark, sf_dir):
    rows = people(spark, sf_dir).where("record_id LIKE '%-0'")
    none = F.lit(None).cast("string")
    return rows.withColumns({"middle_name": none, "name_suffix": none, "full_name": F.concat_ws(" ", "given_name", "family_name")})


def _u(salt: str) -> str:
    return f"('0x' || substr(md5(record_id || '|{salt}'), 1, 8))::BIGINT"


SWAP_CHANNEL_SQL = f"""SELECT record_id, 'name_order_swap' AS channel, unnest(['given_name', 'family_name']) AS field,
  unnest([given_name, family_name]) AS before, unnest([family_name, given_name]) AS after FROM persons
  WHERE record_id LIKE '%-0' AND {_u("3:name_order_swap:hit")} / 4294967296.0::DOUBLE < 0.3 AND given_name <> family_name"""


#: The clean records that the channels edit.
CLEAN_SQL = """clean AS (SELECT *, NULL::VARCHAR AS middle_name, NULL::VARCHAR AS name_suffix, given_name || ' ' || family_name AS full_name
  FROM persons WHERE record_id LIKE '%-0')"""


def _hit(name: str) -> str:
    return f"{_u(f'3:{name}:hit')} / 4294967296.0::DOUBLE < 0.3"


def _log(name: str, cells: dict[str, str]) -> str:
    """Log of the cells that differ, from the new value of each field."""
    rows = " UNION ALL ".join(f"SELECT record_id, '{name}' AS channel, '{f}' AS field, {f} AS before, ({v})::VARCHAR AS after FROM drawn" for f, v in cells.items())
    return f"SELECT * FROM ({rows}) WHERE before IS DISTINCT FROM after"


def _drawn(name: str, fields: list[str], more: str = "") -> str:
    """Hit records with the populated field that the draw chooses, and the draws asked for."""
    filled = "list_filter([" + ", ".join(f"CASE WHEN nullif({f}, '') IS NOT NULL THEN '{f}' END" for f in fields) + "], lambda x: x IS NOT NULL)"
    return f"drawn AS (SELECT *, {filled}[({_u(f'3:{name}:field')} % greatest(len({filled}), 1) + 1)::INTEGER] AS chosen{more} FROM clean WHERE {_hit(name)})"


def _case_like(template: str, value: str) -> str:
    return f"CASE WHEN {template} = upper({template}) AND {template} <> lower({template}) THEN upper({value}) WHEN {template} = lower({template}) THEN lower({value}) ELSE upper({value}[1]) || lower({value}[2:]) END"


def _nickname_sql() -> str:
    swaps: dict[str, set[str]] = {}
    for name, variants in channels.NICKNAMES.items():
        for v in variants:
            swaps.setdefault(name, set()).add(v)
            swaps.setdefault(v, set()).add(name)
    table = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{v}'" for v in sorted(vs))) for k, vs in sorted(swaps.items()))
    return f"""names(k, options) AS (VALUES {table}),
drawn AS (SELECT *, options[({_u("3:nickname:which")} % len(options) + 1)::INTEGER] AS one FROM clean JOIN names ON lower(trim(given_name)) = k WHERE {_hit("nickname")})"""


def _typo_sql() -> str:
    keys = ", ".join(f"('{k}', '{v}')" for k, v in channels.neighbour_keys().items())
    fields = ["given_name", "family_name", "street", "city"]
    value = "CASE chosen " + " ".join(f"WHEN '{f}' THEN {f}" for f in fields) + " END"
    return f"""keys(k, near0) AS (VALUES {keys}),
{_drawn("typo", fields).replace("drawn AS", "chosen0 AS")},
chosen1 AS (SELECT *, {value} AS v, {_u("3:typo:kind")} % 10 AS kind, chr((97 + {_u("3:typo:letter")} % 26)::INTEGER) AS letter FROM chosen0),
chosen2 AS (SELECT *, ({_u("3:typo:at")} % greatest(length(v), 1) + 1)::INTEGER AS pos FROM chosen1 WHERE v IS NOT NULL),
chosen3 AS (SELECT *, v[pos] AS old, coalesce(near0, 'e') AS near FROM chosen2 LEFT JOIN keys ON k = lower(v[pos])),
chosen4 AS (SELECT *, near[({_u("3:typo:near")} % length(near) + 1)::INTEGER] AS put0 FROM chosen3),
typed AS (SELECT *, CASE WHEN kind < 6 THEN left(v, pos - 1) || CASE WHEN old = upper(old) THEN upper(put0) ELSE put0 END || v[pos + 1:]
    WHEN kind = 6 THEN left(v, pos - 1) || letter || v[pos:] WHEN kind = 7 THEN left(v, pos - 1) || v[pos + 1:]
    WHEN kind = 8 THEN left(v, pos - 1) || v[pos + 1:pos + 1] || old || v[pos + 2:] ELSE left(v, pos - 1) || letter || v[pos + 1:] END AS now FROM chosen4)"""


def _pair_sql() -> str:
    """The scanner's confusions: the first place of the drawn string that the value holds."""
    fields = ["given_name", "family_name", "street", "city", "zip", "phone", "dob"]
    value = "CASE chosen " + " ".join(f"WHEN '{f}' THEN {f}" for f in fields) + " END"
    pairs = [p for a, b in channels.OCR_PAIRS for p in ((a, b), (b, a))]
    fits = "list_filter([" + ", ".join(f"CASE WHEN contains(v, '{a}') THEN {{'a': '{a}', 'b': '{b}'}} END" for a, b in pairs) + "], lambda x: x IS NOT NULL)"
    return f"""{_drawn("ocr", fields).replace("drawn AS", "chosen0 AS")},
chosen1 AS (SELECT *, {value} AS v FROM chosen0), chosen2 AS (SELECT *, {fits} AS fits FROM chosen1 WHERE v IS NOT NULL),
chosen3 AS (SELECT *, fits[({_u("3:ocr:pair")} % len(fits) + 1)::INTEGER] AS one FROM chosen2 WHERE len(fits) > 0),
typed AS (SELECT *, left(v, instr(v, one.a) - 1) || one.b || v[instr(v, one.a) + length(one.a):] AS now FROM chosen3)"""


def _sound_sql() -> str:
    """The drawn sound rewrite that fits the chosen value."""
    fields = ["given_name", "family_name", "city"]
    value = "CASE chosen " + " ".join(f"WHEN '{f}' THEN {f}" for f in fields) + " END"
    forms = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{a}') THEN regexp_replace(low, '{a}', '{b}', 'g') END" for a, b in channels.PHONETIC) + "], lambda x: x IS NOT NULL)"
    return f"""{_drawn("phonetic_spelling", fields).replace("drawn AS", "chosen0 AS")},
chosen1 AS (SELECT *, {value} AS v, lower({value}) AS low FROM chosen0), chosen2 AS (SELECT *, {forms} AS forms FROM chosen1 WHERE v IS NOT NULL),
chosen3 AS (SELECT *, forms[({_u("3:phonetic_spelling:rule")} % len(forms) + 1)::INTEGER] AS one FROM chosen2 WHERE len(forms) > 0),
typed AS (SELECT *, {_case_like("v", "one")} AS now FROM chosen3)"""


def _format_sql() -> dict[str, str]:
    """New values of one drawn field: the date's, street's or phone's."""
    pick, day = f"{_u('3:field_format_drift:field')} % 3", f"(1 + {_u('3:field_format_drift:dob')} % 4) % 5"
    shapes = ("%m/%d/%Y", "%Y%m%d", "%m-%d-%Y", "%d %b %Y")
    dob = f"CASE {day} " + " ".join(f"WHEN {i} THEN strftime(dob::DATE, '{f}')" for i, f in enumerate(shapes, 1)) + " END"
    swaps = " ".join(f"WHEN '{a}' THEN '{b.capitalize()}' WHEN '{b}' THEN '{a.capitalize()}'" for a, b in ABBREVIATIONS.items())
    street = f"array_to_string(list_transform(string_split(street, ' '), lambda w: CASE upper(w) {swaps} ELSE w END), ' ')"
    a, b, e = "phone[1:3]", "phone[4:6]", "phone[7:10]"
    forms = f"list_filter([phone, {a} || '-' || {b} || '-' || {e}, '(' || {a} || ') ' || {b} || '-' || {e}, {a} || '.' || {b} || '.' || {e}], lambda x: x <> phone)"
    phone = f"{forms}[({_u('3:field_format_drift:phone')} % 3 + 1)::INTEGER]"
    return {f: f"CASE WHEN {pick} = {i} AND {f} IS NOT NULL THEN {v} ELSE {f} END" for i, (f, v) in enumerate((("dob", dob), ("street", street), ("phone", phone)))}


def _typed(name: str) -> str:
    return f"SELECT record_id, '{name}' AS channel, chosen AS field, v AS before, now AS after FROM typed WHERE now IS DISTINCT FROM v"


DROPPED = ["dob", "zip", "phone", "email", "street"]
HUBBED = [f for f in channels.HUBS if f != "birth_year"]
FORMS = "list_filter([upper(given_name), lower(given_name), given_name || '.'], lambda x: x <> given_name)"
SUFFIX = f"CASE WHEN {_u('3:suffix_confusion:which')} % 4 < 2 THEN 'jr' WHEN {_u('3:suffix_confusion:which')} % 4 = 2 THEN 'sr' ELSE 'ii' END"
CHANNEL_SQL: dict[str, str] = {
    "name_order_swap": with_sql(*BASE, select=SWAP_CHANNEL_SQL),
    "field_dropout": with_sql(*BASE, CLEAN_SQL, _drawn("field_dropout", DROPPED), select=_log("field_dropout", {f: f"CASE WHEN chosen <> '{f}' THEN {f} END" for f in DROPPED})),
    "hub_value": with_sql(*BASE, CLEAN_SQL, _drawn("hub_value", HUBBED), select=_log("hub_value", {f: f"CASE WHEN chosen = '{f}' THEN '{channels.HUBS[f]}' ELSE {f} END" for f in HUBBED})),
    "suffix_confusion": with_sql(
        *BASE, CLEAN_SQL, f"drawn AS (SELECT * FROM clean WHERE {_hit('suffix_confusion')})", select=_log("suffix_confusion", {"name_suffix": _case_like("family_name", f"({SUFFIX})")})
    ),
    "raw_unparse": with_sql(
        *BASE, CLEAN_SQL, f"drawn AS (SELECT * FROM clean WHERE {_hit('raw_unparse')})", select=_log("raw_unparse", {"full_name": "family_name || ', ' || given_name", "given_name": "NULL", "family_name": "NULL"})
    ),
    "name_format_drift": with_sql(
        *BASE, CLEAN_SQL, f"drawn AS (SELECT * FROM clean WHERE {_hit('name_format_drift')})",
        select=_log("name_format_drift", {"given_name": f"{FORMS}[({_u('3:name_format_drift:form')} % greatest(len({FORMS}), 1) + 1)::INTEGER]"}),
    ),
    "nickname": with_sql(*BASE, CLEAN_SQL, _nickname_sql(), select=_log("nickname", {"given_name": _case_like("given_name", "one")})),
    "typo": with_sql(*BASE, CLEAN_SQL, _typo_sql(), select=_typed("typo")),
    "ocr": with_sql(*BASE, CLEAN_SQL, _pair_sql(), select=_typed("ocr")),
    "field_format_drift": with_sql(*BASE, CLEAN_SQL, f"drawn AS (SELECT * FROM clean WHERE {_hit('field_format_drift')})", select=_log("field_format_drift", _format_sql())),
    "phonetic_spelling": with_sql(*BASE, CLEAN_SQL, _sound_sql(), select=_typed("phonetic_spelling")),
}


def _channel(name: str, sql: str | None = None):
    @query(f"noise_{name}", sql)
    def run(spark, sf_dir):
        return channels.REGISTRY[name]().apply(_clean(spark, sf_dir), 0.3, seed=3)[1]


for _name in channels.REGISTRY:
    _channel(_name, CHANNEL_SQL.get(_name))


POOL = [("1 Oak Street", "10001"), ("2 Elm Drive", "10002"), ("3 Mill Road", "10003")]
POOL_SQL = "[" + ", ".join(f"{{'street': '{a}', 'zip': '{b}'}}" for a, b in POOL) + f"][({_u('3:pool_redraw:row')} % {len(POOL)} + 1)::INTEGER]"


@query(
    "noise_pool_redraw",
    with_sql(*BASE, CLEAN_SQL, f"drawn AS (SELECT *, {POOL_SQL} AS one FROM clean WHERE {_hit('pool_redraw')})", select=_log("pool_redraw", {"street": "one.street", "zip": "one.zip"})),
)
def noise_pool_redraw(spark, sf_dir):
    channel = channels.pool_redraw(["street", "zip"], POOL)
    return channel.apply(_clean(spark, sf_dir), 0.3, seed=3)[1]


RATES = {"typo": 0.3, "nickname": 0.1, "field_dropout": 0.2, "field_format_drift": 0.2, "hub_value": 0.05}


@query("generated_corpus")
def generated_corpus(spark, sf_dir):
    return generate.generate_corpus(_clean(spark, sf_dir), RATES, seed=11)[0]


@query("ops_log")
def ops_log(spark, sf_dir):
    return generate.generate_corpus(_clean(spark, sf_dir), RATES, seed=11)[1]


def _house_sql() -> str:
    names = sorted({n.capitalize() for n in ("robert", "alice", "peter", "helen", "thomas", "clara", "simon", "teresa", "victor", "diana", "ingrid", "felix")})
    pool = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""kinds AS (SELECT *, {_u("5:kind")} / 4294967296.0::DOUBLE AS u, {_u("5:name")} % {len(names)} AS spot, {_u("5:gap")} % 10 + 1 AS years, {_u("5:sign")} % 2 AS sign, {_u("5:age")} % 16 + 20 AS age
  FROM clean WHERE {_u("5:house")} / 4294967296.0::DOUBLE < 0.2),
kin AS (SELECT *, CASE WHEN u < 0.5 THEN 'sibling' WHEN u < 0.75 THEN 'twin' ELSE 'jr_sr' END AS kind, {pool}[spot::INTEGER + 1] AS drawn, {pool}[((spot + 1) % {len(names)})::INTEGER + 1] AS following FROM kinds)
SELECT * EXCLUDE (u, spot, years, sign, age, kind, drawn, following) REPLACE (record_id || '#hh1' AS record_id, entity_id || '#hh1' AS entity_id, CASE WHEN kind = 'jr_sr' THEN 'JR' ELSE name_suffix END AS name_suffix,
  CASE WHEN kind = 'jr_sr' THEN given_name WHEN lower(drawn) = lower(given_name) THEN following ELSE drawn END AS given_name,
  CASE kind WHEN 'twin' THEN dob WHEN 'jr_sr' THEN strftime(dob::DATE + to_years(age::INTEGER), '%Y-%m-%d') ELSE strftime(dob::DATE + to_years((CASE WHEN sign = 0 THEN years ELSE -years END)::INTEGER), '%Y-%m-%d') END AS dob) FROM kin"""


@query("household_confusables", with_sql(*BASE, CLEAN_SQL, select="").rstrip() + ",\n" + _house_sql())
def household_confusables(spark, sf_dir):
    return generate.household_confusables(_clean(spark, sf_dir), 0.2, seed=5)[0]


@query("generated_audit")
def generated_audit(spark, sf_dir):
    corpus = materialize(generate.generate_corpus(_clean(spark, sf_dir), RATES, seed=11)[0], "corpus")
    pairs = generate.originals_with_duplicates(corpus, FIELDS)
    return audit.report(pairs, FIELDS, channels.NICKNAMES, key="record_id")


SPREAD_SQL = """spelt AS (SELECT DISTINCT entity_id, list_sort(list_distinct(list_filter(string_split_regex(trim(given_name || ' ' || family_name), '\\s+'), lambda t: t <> ''))) AS t FROM persons)
SELECT entity_id, any_value(n) AS n_names, round(max(1.0::DOUBLE - len(list_intersect(l.t, r.t)) / len(list_distinct(l.t || r.t))::DOUBLE), 6) AS spread
FROM spelt l JOIN spelt r USING (entity_id) JOIN (SELECT entity_id, count(*) AS n FROM spelt GROUP BY 1) USING (entity_id) GROUP BY entity_id"""


@query("name_spread", with_sql(*BASE, select="").rstrip() + ",\n" + SPREAD_SQL)
def name_spread(spark, sf_dir):
    rows = people(spark, sf_dir).withColumn("full_name", F.concat_ws(" ", "given_name", "family_name"))
    return audit.name_spread(rows).withColumn("spread", r6("spread"))
