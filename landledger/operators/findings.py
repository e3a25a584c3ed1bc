"""Findings: one struct type for every check, and their texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.text import day_label, mapped, quoted

FINDING = "struct<field:string,kind:string,code:string,params:map<string,string>,issue:string>"
FINDINGS = f"array<{FINDING}>"
EMPTY = f"cast(array() as {FINDINGS})"
PENALTY_OF_KIND = mapped("kind", fixed.PENALTY, "0")


def filled_text(template: str, values: dict[str, str]) -> str:
    """SQL text of a template with its placeholders replaced by expressions."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    shown = [
        f"coalesce(cast({values[p[1:-1]]} as string), '')" if p[0] == "{" and p[1:-1] in values else quoted(p)
        for p in parts
    ]
    return f"concat({', '.join(shown)})"


def finding(
    field: str,
    kind: str,
    code: str,
    params: dict[str, str] | None = None,
    shown: dict[str, str] | None = None,
) -> str:
    """SQL text of one finding.

    ``field`` is a SQL expression, ``params`` maps names to SQL expressions, and
    ``shown`` overrides how a parameter reads in the English text.
    """
    params = {k: f"coalesce(cast({v} as string), '')" for k, v in (params or {}).items()}
    packed = ", ".join(f"{quoted(k)}, {v}" for k, v in params.items())
    return (
        f"cast(named_struct('field', {field}, 'kind', {quoted(kind)}, 'code', {quoted(code)}, 'params', "
        f"cast(map({packed}) as map<string,string>), 'issue', "
        f"{filled_text(fixed.TEXTS[code], {**params, **(shown or {})})}) as {FINDING})"
    )


def gather(*cases: str) -> str:
    """SQL text of the array of findings that apply, in the order given.

    Each case is the body of a CASE: "when <condition> then <finding> ...".
    """
    items = ", ".join(f"case {c} end" for c in cases)
    return f"cast(array_compact(array({items})) as {FINDINGS})"


def penalty_sum(issues: str = "issues") -> str:
    """Points lost to an array of findings."""
    return (
        f"aggregate(coalesce({issues}, {EMPTY}), 0L, "
        f"(total, issue) -> total + {mapped('issue.kind', fixed.PENALTY, '0')})"
    )


def explode_findings(df: DataFrame, keys: list[str], column: str = "issues") -> DataFrame:
    """One row per finding with its position in the list.

    Records without findings go after the list is spread out. The filter that Spark would add
    before it works the whole list out once more, and every map it looks into once a look.
    """
    spread = df.select(*keys, F.posexplode_outer(column).alias("ord", "f")).filter("ord is not null")
    return spread.select(*keys, "ord", "f.*")


# --- rendering -----------------------------------------------------------

def english_catalogue(spark: SparkSession) -> DataFrame:
    """The English texts as a catalogue table: locale, key, one, other."""
    rows = []
    for code, text in fixed.TEXTS.items():
        if not code.endswith(".one"):
            rows.append(("en", f"findings.{code}", fixed.TEXTS.get(f"{code}.one"), text))
    for space, labels in (
        ("fields", fixed.RECORD_LABELS), ("orderFields", fixed.ORDER_LABELS),
        ("sources", fixed.SOURCE_LABELS), ("mutationTypes", fixed.TRANSFER_LABELS),
    ):
        rows += [("en", f"{space}.{k}", None, v) for k, v in labels.items()]
    rows.append(("en", "chain.theWholeParcel", None, fixed.WHOLE_PARCEL_TEXT))
    return spark.createDataFrame(rows, "locale string, key string, one string, other string")


def render_findings(findings: DataFrame, catalogue: DataFrame, locale: str) -> DataFrame:
    """Add ``rendered``: each finding in the reader's language.

    The catalogue holds one row per (locale, key); its size is fixed by the number of
    texts, never by the data, so each language is packed into one map and broadcast as
    a single row. A key missing in the locale falls back to English; a finding without
    a known code keeps its own text.
    """
    def packed(of: str, name: str) -> DataFrame:
        entry = F.struct("key", F.struct("one", "other"))
        return catalogue.filter(F.col("locale") == of).agg(
            F.map_from_entries(F.collect_list(entry)).alias(name)
        )

    texts = packed("en", "english").join(packed(locale, "local"))
    joined = findings.join(F.broadcast(texts))

    def text(key: str) -> str:
        return f"coalesce(try_element_at(local, {key}), try_element_at(english, {key}))"

    dates = ", ".join(quoted(d) for d in fixed.DATE_PARAMS)
    as_date = "try_to_date(e.value, 'yyyy-MM-dd')"
    space = "if(startswith(code, 'order'), 'orderFields.', 'fields.')"
    shown = (
        "coalesce(case "
        f"when e.key = 'field' then {text(f'concat({space}, e.value)')}.other "
        f"""when e.key = 'source' then {text("concat('sources.', e.value)")}.other """
        f"""when e.key = 'type' then {text("concat('mutationTypes.', e.value)")}.other """
        f"""when e.key = 'share' and e.value = '1' then {text("'chain.theWholeParcel'")}.other """
        f"when e.key in ({dates}) and {as_date} is not null then {day_label(as_date)} "
        "end, e.value)"
    )
    template = text("concat('findings.', coalesce(code, ''))")
    count = "coalesce(try_cast(try_element_at(params, 'count') as double), 0D)"
    # English has the singular for exactly one; the Indian languages for zero too.
    singular = f"{count} = 1" if locale == "en" else f"{count} between 0 and 1"
    rendered = (
        "aggregate(coalesce(map_entries(params), cast(array() as array<struct<key:string,value:string>>)), "
        f"if({singular} and {template}.one is not null, {template}.one, {template}.other), "
        f"(acc, e) -> replace(acc, concat('{{', e.key, '}}'), {shown}))"
    )
    return joined.withColumn("rendered", F.expr(f"coalesce({rendered}, issue, '')")).drop("english", "local")
