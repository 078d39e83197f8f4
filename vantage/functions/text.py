"""Column functions over names, paths, signatures and source text. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage import model as M



def empty_strings() -> Column:
    return F.array().cast("array<string>")


def lookup(values: dict[str, str], key: Column, default: Column) -> Column:
    """A dimension lookup with a default, as a literal map."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), default)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_or_example(path: Column) -> Column:
    """The file's name, not its folders, marks a test or an example."""
    name = file_name(F.lower(path))
    return name.startswith("test_") | name.contains("example")


def normal_path(path: Column) -> Column:
    """Comparable form: forward slashes, none doubled, no "./" steps, lower case."""
    slashes = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(slashes, r"(^|/)(\./)+", "$1"), r"(.)/\.?$", "$1"))


def module_of_path(path: Column) -> Column:
    """The folder that names a file's module: that after the first source root, else the file's own below the top."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    n = F.size(parts)
    places = F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*M.MODULE_ROOTS), i + 1)), lambda i: i.isNotNull())
    first = F.try_element_at(places, F.lit(1))  # 1-based place of the root
    after = F.when(first < n - 1, F.try_element_at(parts, first + 1))
    own = F.when(n > 2, F.try_element_at(parts, n - 1))
    found = F.coalesce(after, F.lit("root"))
    return F.when(found == "root", F.coalesce(own, F.lit("root"))).otherwise(found)


def subsystem_of(module: Column) -> Column:
    """First token of a module's name; names under four characters stay whole."""
    return F.when(F.length(module) < 4, module).otherwise(F.substring_index(F.translate(module, "-.", "__"), "_", 1))


def strip_method(signature: Column) -> Column:
    """Without a leading HTTP method."""
    got = F.regexp_extract(signature, r"^[A-Za-z]+\s+(.+)$", 1)
    return F.when(got == "", signature).otherwise(got)


def last_segment(url: Column) -> Column:
    """The last path segment without placeholders; empty where there is no slash."""
    seg = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    return F.when(url.contains("/"), F.trim(F.regexp_replace(seg, r"\{[^}]*\}", ""))).otherwise("")


def build_patterns(signature: Column, aliases: Column, link_type: Column) -> Column:
    """What to search for in order to find uses of a signature: distinct, in order."""
    none = F.lit(None).cast("string")
    is_url, is_symbol = link_type.isin(*M.URL_LINK_TYPES), link_type.isin(*M.SYMBOL_LINK_TYPES)

    def of(raw: Column) -> Column:
        s = F.trim(F.coalesce(raw, F.lit("")))
        url = strip_method(s)
        seg = last_segment(url)
        return F.array(
            F.when(s != "", s),
            F.when((s != "") & is_url & (url != "") & (url != s), url).otherwise(none),
            F.when((s != "") & is_url & (seg != url) & (F.length(seg) >= 3), seg).otherwise(none),
            F.when(is_symbol & s.contains("::"), F.substring_index(s, "::", -1)).otherwise(none),
            F.when(is_symbol & s.contains("."), F.substring_index(s, ".", -1)).otherwise(none),
        )

    every = F.flatten(F.transform(F.concat(F.array(signature), F.coalesce(aliases, empty_strings())), of))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def overlaps(pattern: Column, signature: Column, aliases: Column) -> Column:
    """Whether a pattern contains, or is contained in, a signature or one of its aliases, case aside."""
    p = F.lower(pattern)
    every = F.transform(F.concat(F.array(signature), F.coalesce(aliases, empty_strings())), lambda s: F.lower(s))
    return F.coalesce(F.exists(every, lambda s: (s != "") & (s.contains(p) | p.contains(s))), F.lit(False))


def match_kind(pattern: Column, signature: Column) -> Column:
    return F.when(pattern == signature, "exact").when(signature.contains(pattern), "normalized").otherwise("symbol")


URL_LITERAL = r"""["'](/[A-Za-z0-9_\-./~?&=:{}%]+)["']"""


def url_literals(code: Column) -> Column:
    """Quoted URL paths in source text, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(URL_LITERAL), F.lit(1)))


def word_pattern(text: str) -> str:
    """A pattern for a whole word, Unicode letters included, that Java and RE2 read alike."""
    return r"(^|[^\p{L}\p{N}_])" + re.escape(text) + r"($|[^\p{L}\p{N}_])"


def line_matches(line: Column, pattern: Column) -> Column:
    """Case-insensitive containment; patterns under four characters must be whole words."""
    low, p = F.lower(line), F.lower(pattern)
    escaped = F.regexp_replace(p, r"([^\p{L}\p{N}_])", r"\\$1")
    word = F.regexp_like(low, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), escaped, F.lit(r"($|[^\p{L}\p{N}_])")))
    return low.contains(p) & ((F.length(pattern) >= 4) | word)


def api_short_name(callee: Column) -> Column:
    """Last dotted segment; null where there is no dot."""
    return F.when(callee.contains("."), F.substring_index(callee, ".", -1))


def clamp(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def path_tail(path: Column, n: int = 3) -> Column:
    """Last n segments of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (n - 1)), n), "/")


def orthogonal(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A polyline of a horizontal, a vertical and a horizontal line, as eight numbers."""
    mid = (x1 + x2) / 2
    return F.array(*[c.cast("double") for c in (x1, y1, mid, y1, mid, y2, x2, y2)])


def flag(value: Column, default: bool) -> Column:
    """An environment switch: off for 0, false, no, off and empty; the default where unset."""
    return F.coalesce(~F.lower(F.trim(value)).isin("0", "false", "no", "off", ""), F.lit(default))


def int_value(value: Column, default: int) -> Column:
    """An environment number, or the default where unset or unreadable."""
    return F.coalesce(F.trim(value).try_cast("int"), F.lit(default))
