"""Push-message texts: rendering templates and cleaning generated text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.scalars import as_col, trim_space


def _templates(tone: str) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("template_id"), F.lit(text).alias("template"))
        for i, text in enumerate(fv.TEMPLATES[tone], 1)
    ])


def template_messages(sku, name, tone, n: int = fv.MESSAGES_PER_PRODUCT) -> Column:
    """``n`` different messages for a product, as an array of (template_id, text).

    Templates are put in an order that is arbitrary but fixed per product and tone. All of
    it happens inside the row; there is no shuffle.
    """
    chosen = F.when(as_col(tone) == fv.URGENT, _templates(fv.URGENT)).otherwise(
        _templates(fv.PLAYFUL)
    )
    keyed = F.transform(chosen, lambda t: F.struct(
        F.md5(F.concat(as_col(sku), F.lit("|"), t["template_id"].cast("string")).cast("binary")).alias("h"),
        t["template_id"].alias("template_id"), t["template"].alias("template"),
    ))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda t: F.struct(
        t["template_id"].alias("template_id"),
        F.replace(t["template"], F.lit("{name}"), as_col(name)).alias("text"),
    ))


def clean_lines(text) -> Column:
    """Usable lines of a generated text: numbering and quotes stripped, short lines out."""
    lines = F.split(as_col(text), "\n")
    cleaned = F.transform(lines, lambda x: _strip(
        trim_space(F.regexp_replace(trim_space(x), "(?U)" + fv.NUMBERING, ""))
    ))
    return F.filter(cleaned, lambda x: F.length(x) > fv.MIN_MESSAGE_LENGTH)


def _strip(line: Column) -> Column:
    return F.btrim(F.btrim(line, F.lit('"')), F.lit("'"))


def clean_callouts(df: DataFrame, keys: list[str], text: str,
                   n: int = fv.MESSAGES_PER_PRODUCT) -> DataFrame:
    """The first ``n`` usable lines of each text, numbered from 1."""
    return df.select(
        *keys, F.posexplode(F.slice(clean_lines(text), 1, n)).alias("pos", "callout")
    ).select(*keys, (F.col("pos") + 1).alias("position"), "callout")


def callouts(products: DataFrame, text: str | None = None) -> DataFrame:
    """Messages per product (``sku, name, tone``): cleaned generated lines where ``text``
    holds any, else the templates."""
    templates = F.transform(template_messages("sku", "name", "tone"), lambda m: m["text"])
    chosen = templates
    if text is not None:
        lines = F.slice(clean_lines(text), 1, fv.MESSAGES_PER_PRODUCT)
        chosen = F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0, lines).otherwise(templates)
    return products.select("sku", "tone", F.posexplode(chosen).alias("id", "text"))
