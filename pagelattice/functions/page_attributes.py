"""The custom attribute of PAGE elements: ``readingOrder {index:4;} structure {id:a1; type:article;}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP, _PAIR = r"(\w+)\s*\{([^}]*)\}", r"([\w.-]+)\s*:\s*([^;]*)"


def parse(custom: Column) -> Column:
    """map<string, map<string, string>>; of equal names the last holds."""
    names = F.regexp_extract_all(custom, F.lit(_GROUP), F.lit(1))
    bodies = F.regexp_extract_all(custom, F.lit(_GROUP), F.lit(2))
    pairs = lambda b: F.map_from_arrays(F.regexp_extract_all(b, F.lit(_PAIR), F.lit(1)), F.transform(F.regexp_extract_all(b, F.lit(_PAIR), F.lit(2)), lambda v: F.trim(v)))
    return F.map_from_arrays(names, F.transform(bodies, pairs))


def render(custom: Column) -> Column:
    """The text form of a parsed attribute, groups and keys in order of name."""
    body = lambda m: F.concat_ws(" ", F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit(";"))))
    groups = F.transform(F.sort_array(F.map_keys(custom)), lambda k: F.concat(k, F.lit(" {"), body(F.element_at(custom, k)), F.lit("}")))
    return F.concat_ws(" ", groups)


def value(custom: Column, group: str, key: str) -> Column:
    """One value of a parsed attribute or null."""
    return F.try_element_at(F.try_element_at(custom, F.lit(group)), F.lit(key))


def with_value(custom: Column, group: str, key: str, new: Column) -> Column:
    """The attribute with one value set; a null value removes it."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old = F.coalesce(F.try_element_at(custom, F.lit(group)), empty)
    rest = F.map_filter(old, lambda k, _: k != key)
    inner = F.when(new.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), new)))
    return F.map_concat(F.map_filter(custom, lambda k, _: k != group), F.create_map(F.lit(group), inner))


def reading_order(custom: Column) -> Column:
    return value(custom, "readingOrder", "index").try_cast("int")


def article_id(custom: Column) -> Column:
    """The structure id, if the structure is an article."""
    return F.when(value(custom, "structure", "type") == "article", value(custom, "structure", "id"))


def with_article_id(custom: Column, new: Column) -> Column:
    """Sets id and type; a null id removes the id and keeps the type."""
    typed = F.when(new.isNotNull(), with_value(custom, "structure", "type", F.lit("article"))).otherwise(custom)
    return with_value(typed, "structure", "id", new)


def article_number(article: Column) -> Column:
    """The number of an id ``a<n>``, for sorting; nulls last."""
    return F.regexp_extract(article, r"(\d+)", 1).try_cast("int")
