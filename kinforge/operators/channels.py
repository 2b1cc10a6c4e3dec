"""Noise channels: seeded edits of records, each with a log of changed cells.

A channel is a set of column expressions over hashed draws keyed by (record,
channel, seed): the same records change however the table is dealt out. The log
holds one row (record_id, channel, field, before, after) for each changed cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import dates
from kinforge.functions.draws import draw, uniform
from kinforge.functions.strings import empty_to_null
from kinforge.operators.audit import ABBREVIATIONS

OPS = "record_id string, channel string, field string, before string, after string"

#: Neighbours on a QWERTY keyboard, by row position.
_KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Characters that scanners confuse.
OCR_PAIRS = (("0", "O"), ("1", "l"), ("5", "S"), ("8", "B"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("2", "Z"), ("6", "G"), ("I", "l"))
#: Sound rewrites as anchored patterns.
PHONETIC = (("ph", "f"), ("^kn", "n"), ("ck", "k"), ("^wr", "r"), ("ie$", "y"), ("y$", "ie"), ("ch", "sh"), ("tt", "t"), ("ll", "l"), ("ss", "s"), ("ee", "ea"), ("th$", "t"))
#: A small nickname lexicon of common English names.
NICKNAMES: dict[str, list[str]] = {
    "robert": ["bob", "rob", "bobby"],
    "thomas": ["tom", "tommy"],
    "peter": ["pete"],
    "henry": ["harry", "hank"],
    "martha": ["marty", "mattie"],
    "alice": ["allie"],
    "helen": ["nell", "ellie"],
    "teresa": ["terry", "tess"],
    "diana": ["di"],
    "walter": ["walt"],
    "judith": ["judy"],
    "simon": ["si"],
    "victor": ["vic"],
    "marcus": ["marc"],
    "clara": ["clare"],
    "william": ["bill", "will"],
    "elizabeth": ["liz", "beth"],
    "james": ["jim", "jimmy"],
}
#: Which suffixes each suffix is confused with.
SUFFIXES = {"JR": ("SR", "II"), "SR": ("JR",), "II": ("JR", "III"), "III": ("II", "IV"), "IV": ("III",)}
#: Placeholder values that registries use.
HUBS = {"phone": "0000000", "street": "GENERAL DELIVERY", "birth_year": "1900", "dob": "1900-01-01"}


def neighbour_keys() -> dict[str, str]:
    """Keys beside each letter key."""
    out = {}
    for row in _KEY_ROWS:
        for i, c in enumerate(row):
            out[c] = row[max(0, i - 1) : i] + row[i + 1 : i + 2]
    return out


def match_case(template: Column, value: Column) -> Column:
    """``value`` in upper, lower or capitalised form like ``template``."""
    return (
        F.when((template == F.upper(template)) & (template != F.lower(template)), F.upper(value))
        .when(template == F.lower(template), F.lower(value))
        .otherwise(F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 1_000_000))))
    )


@dataclass(frozen=True)
class Channel:
    """A named edit: ``edit(df, key)`` gives new values of some columns, by name.

    ``key(salt)`` is a draw for the row; a value that is null or equal to the old
    one under ``<=>`` counts as no change.
    """

    name: str
    edit: Callable[[DataFrame, Callable[[str], Column]], dict[str, Column]]

    def apply(self, df: DataFrame, rate: Column | float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """(changed table, log of changed cells)."""
        rate = F.lit(float(rate)) if isinstance(rate, float | int) else rate
        hit = uniform("record_id", f"{seed}:{self.name}:hit") < rate

        def key(salt: str) -> Column:
            return draw("record_id", f"{seed}:{self.name}:{salt}")

        new = {c: v for c, v in self.edit(df, key).items() if c in df.columns}
        wide = df.withColumns({f"__new_{c}": F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})
        cells = [F.struct(F.lit(c).alias("field"), F.col(c).alias("before"), F.col(f"__new_{c}").alias("after"), (~F.col(c).eqNullSafe(F.col(f"__new_{c}"))).alias("moved")) for c in new]
        if cells:
            log = wide.select("record_id", F.explode(F.array(*cells)).alias("x")).where("x.moved").select("record_id", F.lit(self.name).alias("channel"), "x.field", "x.before", "x.after")
        else:
            log = df.sparkSession.createDataFrame([], OPS)
        out = wide.select(*[F.col(f"__new_{c}").alias(c) if c in new else F.col(c) for c in df.columns])
        return out, log


def _one_field(fields: list[str], columns: list[str], n: Column, change: Callable[[Column], Column]) -> dict[str, Column]:
    """Apply ``change`` to one of the populated fields, chosen by a draw."""
    fields = [f for f in fields if f in columns]
    filled = F.filter(F.array(*[F.when(empty_to_null(F.col(f)).isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    chosen = F.when(F.size(filled) > 0, F.get(filled, (n % F.greatest(F.size(filled), F.lit(1))).cast("int")))
    return {f: F.when(chosen == f, change(F.col(f))).otherwise(F.col(f)) for f in fields}


def _splice(c: Column, at: Column, drop: Column | int, put: Column) -> Column:
    """``c`` with ``drop`` characters from position ``at`` (1-based) replaced."""
    drop = F.lit(drop) if isinstance(drop, int) else drop
    return F.concat(F.substring(c, F.lit(1), at - 1), put, F.substring(c, at + drop, F.lit(1_000_000)))


def typo(fields: tuple[str, ...] = ("given_name", "middle_name", "family_name", "street", "city")) -> Channel:
    """A keyboard neighbour (six in ten), or an insert, delete, swap or substitute."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        keys = F.create_map(*[F.lit(x) for kv in neighbour_keys().items() for x in kv])

        def change(c: Column) -> Column:
            at = (key("at") % F.greatest(F.length(c), F.lit(1)) + 1).cast("int")
            old = F.substring(c, at, F.lit(1))
            near = F.coalesce(F.try_element_at(keys, F.lower(old)), F.lit("e"))
            put = F.substring(near, (key("near") % F.greatest(F.length(near), F.lit(1)) + 1).cast("int"), F.lit(1))
            put = F.when(old == F.upper(old), F.upper(put)).otherwise(put)
            letter = F.chr(F.lit(97) + key("letter") % 26)
            kind = key("kind") % 10
            swapped = F.concat(F.substring(c, at + 1, F.lit(1)), old)
            return (
                F.when(kind < 6, _splice(c, at, 1, put))
                .when(kind == 6, _splice(c, at, 0, letter))
                .when(kind == 7, _splice(c, at, 1, F.lit("")))
                .when(kind == 8, _splice(c, at, 2, swapped))
                .otherwise(_splice(c, at, 1, letter))
            )

        return _one_field(list(fields), df.columns, key("field"), change)

    return Channel("typo", edit)


def ocr(fields: tuple[str, ...] = ("given_name", "middle_name", "family_name", "street", "city", "zip", "phone", "dob")) -> Channel:
    """The first place of a drawn confusable string is replaced."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        pairs = [p for a, b in OCR_PAIRS for p in ((a, b), (b, a))]

        def change(c: Column) -> Column:
            fits = F.filter(F.array(*[F.when(c.contains(a), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in pairs]), lambda x: x.isNotNull())
            one = F.get(fits, (key("pair") % F.greatest(F.size(fits), F.lit(1))).cast("int"))
            return F.when(F.size(fits) > 0, _splice(c, F.instr(c, one["a"]), F.length(one["a"]), one["b"])).otherwise(c)

        return _one_field(list(fields), df.columns, key("field"), change)

    return Channel("ocr", edit)


def phonetic_spelling(fields: tuple[str, ...] = ("given_name", "middle_name", "family_name", "city")) -> Channel:
    """A drawn sound rewrite that fits the value."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        def change(c: Column) -> Column:
            low = F.lower(c)
            forms = F.filter(F.array(*[F.when(low.rlike(a), F.regexp_replace(low, a, b)) for a, b in PHONETIC]), lambda x: x.isNotNull())
            one = F.get(forms, (key("rule") % F.greatest(F.size(forms), F.lit(1))).cast("int"))
            return F.when(F.size(forms) > 0, match_case(c, one)).otherwise(c)

        return _one_field(list(fields), df.columns, key("field"), change)

    return Channel("phonetic_spelling", edit)


def nickname(lexicon: dict[str, list[str]] | None = None) -> Channel:
    """given_name becomes another name of its class, case kept."""
    swaps: dict[str, set[str]] = {}
    for name, variants in (lexicon or NICKNAMES).items():
        for v in variants:
            swaps.setdefault(name.lower(), set()).add(v.lower())
            swaps.setdefault(v.lower(), set()).add(name.lower())

    def edit(df: DataFrame, key) -> dict[str, Column]:
        table = F.create_map(*[y for k in sorted(swaps) for y in (F.lit(k), F.array(*map(F.lit, sorted(swaps[k]))))])
        c = F.col("given_name")
        options = F.try_element_at(table, F.lower(F.trim(c)))
        one = F.get(options, (key("which") % F.greatest(F.size(options), F.lit(1))).cast("int"))
        return {"given_name": F.when(options.isNotNull(), match_case(c, one)).otherwise(c)}

    return Channel("nickname", edit)


def name_order_swap() -> Channel:
    """given_name and family_name change places when both are there."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        g, f = F.col("given_name"), F.col("family_name")
        both = empty_to_null(g).isNotNull() & empty_to_null(f).isNotNull()
        return {"given_name": F.when(both, f).otherwise(g), "family_name": F.when(both, g).otherwise(f)}

    return Channel("name_order_swap", edit)


def field_dropout(fields: tuple[str, ...] = ("middle_name", "dob", "zip", "phone", "email", "street")) -> Channel:
    """One populated field becomes null."""
    return Channel("field_dropout", lambda df, key: _one_field(list(fields), df.columns, key("field"), lambda c: F.lit(None).cast("string")))


def phone_forms(c: Column) -> Column:
    """Other punctuations of a phone number of 7 or 10 digits."""
    d = F.regexp_replace(c, "[^0-9]", "")
    a, b, e = F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)
    ten = F.array(d, F.concat_ws("-", a, b, e), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), e), F.concat_ws(".", a, b, e))
    seven = F.array(d, F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4)))
    forms = F.when(F.length(d) == 10, ten).when(F.length(d) == 7, seven).otherwise(F.array().cast("array<string>"))
    return F.filter(forms, lambda x: x != c)


def field_format_drift() -> Channel:
    """A date in another format, a street with other abbreviations, a phone re-punctuated."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        out = {}
        dob = F.col("dob")
        if "dob" in df.columns:
            n = (dates.format_of(dob) + 1 + key("dob") % (len(dates.FORMATS) - 1)) % len(dates.FORMATS)
            out["dob"] = F.coalesce(dates.render(dates.parse(dob), n), dob)
        if "street" in df.columns:
            table = F.create_map(*[F.lit(x) for a, b in ABBREVIATIONS.items() for x in (a, b)])
            words = F.transform(F.split(F.col("street"), " "), lambda w: F.coalesce(F.initcap(F.try_element_at(table, F.upper(w))), w))
            out["street"] = F.array_join(words, " ")
        if "phone" in df.columns:
            forms = phone_forms(F.col("phone"))
            out["phone"] = F.coalesce(F.get(forms, (key("phone") % F.greatest(F.size(forms), F.lit(1))).cast("int")), F.col("phone"))
        pick = key("field") % max(1, len(out))
        return {c: F.when(pick == i, v).otherwise(F.col(c)) for i, (c, v) in enumerate(out.items())}

    return Channel("field_format_drift", edit)


def suffix_confusion() -> Channel:
    """Add, drop or confuse a name suffix, in the case of the suffix or, if added, of the family name."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        c, n = F.col("name_suffix"), key("which") % 4
        added = F.when(n < 2, "jr").when(n == 2, "sr").otherwise("ii")
        like = empty_to_null(F.col("family_name")) if "family_name" in df.columns else F.lit(None).cast("string")
        table = F.create_map(*[x for k, v in SUFFIXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        options = F.try_element_at(table, F.trim(F.lit("."), F.upper(c)))
        other = F.get(options, (key("other") % F.greatest(F.size(options), F.lit(1))).cast("int"))
        confused = F.when((n >= 2) & options.isNotNull(), match_case(c, other))  # else it is dropped
        return {"name_suffix": F.when(empty_to_null(c).isNull(), match_case(F.coalesce(like, F.lit("Xx")), added)).otherwise(confused)}

    return Channel("suffix_confusion", edit)


def hub_value() -> Channel:
    """One populated field takes a placeholder value."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        out = _one_field([f for f in HUBS if f in df.columns], df.columns, key("field"), lambda c: F.lit("?"))
        return {f: F.when(v == "?", F.lit(HUBS[f])).otherwise(F.col(f)) for f, v in out.items()}

    return Channel("hub_value", edit)


def raw_unparse() -> Channel:
    """Names fold into full_name as FAMILY, GIVEN MIDDLE SUFFIX and lose their columns."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        have = [c for c in ("given_name", "middle_name", "name_suffix") if c in df.columns]
        rest = F.concat_ws(" ", *[empty_to_null(F.col(c)) for c in have])
        full = F.concat_ws(", ", empty_to_null(F.col("family_name")), F.nullif(rest, F.lit("")))
        none = F.lit(None).cast("string")
        return {"full_name": full, **{c: none for c in [*have, "family_name"]}}

    return Channel("raw_unparse", edit)


def pool_redraw(fields: list[str], pool: list[tuple[str, ...]]) -> Channel:
    """The fields take another real tuple of values together."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        rows = F.array(*[F.array(*map(F.lit, row)) for row in pool])
        one = F.element_at(rows, (key("row") % len(pool) + 1).cast("int"))
        return {f: one[i] for i, f in enumerate(fields)}

    return Channel("pool_redraw", edit)


def name_format_drift() -> Channel:
    """Another case or punctuation of given_name with the same letters."""

    def edit(df: DataFrame, key) -> dict[str, Column]:
        c = F.col("given_name")
        forms = F.filter(F.array(F.upper(c), F.lower(c), F.concat(c, F.lit("."))), lambda x: x != c)
        return {"given_name": F.coalesce(F.get(forms, (key("form") % F.greatest(F.size(forms), F.lit(1))).cast("int")), c)}

    return Channel("name_format_drift", edit)


REGISTRY: dict[str, Callable[[], Channel]] = {
    "typo": typo,
    "ocr": ocr,
    "phonetic_spelling": phonetic_spelling,
    "nickname": nickname,
    "name_order_swap": name_order_swap,
    "field_dropout": field_dropout,
    "field_format_drift": field_format_drift,
    "suffix_confusion": suffix_confusion,
    "hub_value": hub_value,
    "raw_unparse": raw_unparse,
    "name_format_drift": name_format_drift,
}


def parse_lexicon(lines: list[str]) -> dict[str, list[str]]:
    """Nickname lines: ``name,variant,...``, or ``name1,relationship,name2`` under such a header."""
    rows = [[x.strip().lower() for x in line.split(",")] for line in lines if line.strip()]
    out: dict[str, list[str]] = {}
    if rows and rows[0][:3] == ["name1", "relationship", "name2"]:
        for a, _, b, *_ in rows[1:]:
            out.setdefault(a, []).append(b)
    else:
        for name, *variants in rows:
            out.setdefault(name, []).extend(v for v in variants if v)
    return out


def sync_full_name(df: DataFrame, before: DataFrame) -> DataFrame:
    """Carry changes of given and family name into full_name (first occurrence)."""
    old = before.select("record_id", *[F.col(c).alias(f"__{c}") for c in ("given_name", "family_name")])
    joined = df.join(old, "record_id", "left")
    full = F.col("full_name")
    for c in ("given_name", "family_name"):
        was, now = empty_to_null(F.col(f"__{c}")), F.coalesce(F.col(c), F.lit(""))
        at = F.instr(full, was)
        full = F.when((at > 0) & ~F.col(f"__{c}").eqNullSafe(F.col(c)), _splice(full, at, F.length(was), now)).otherwise(full)
    return joined.select(*[full.alias(c) if c == "full_name" else F.col(c) for c in df.columns])
