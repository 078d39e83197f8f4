"""Links between repositories: endpoints' signatures looked for in the other side's source text.

Patterns grow with endpoints, so testing every line against every pattern grows with the square of the project. Up to
``BROADCAST_PATTERNS`` patterns are broadcast and tested. Beyond that a pattern is looked for only in lines that have
its rarest three characters: the trigrams of all lines are counted, each pattern is keyed by that of its own which
occurs least (one that no line has can't match), and an equi-join on it leaves the pairs that are then tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage import model as M
from vantage.functions.text import build_patterns, line_matches, match_kind, overlaps
from vantage.runtime import settled

BROADCAST_PATTERNS = 100
CONFIDENCE = "medium"


def compatibility(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(M.COMPATIBLE, "interface_kind string, link_type string"))


def endpoints_for(endpoints: DataFrame, role: str, with_types: bool = True) -> DataFrame:
    """Endpoints of a role that have a signature, with a row for every link type that their kind fits.

    Without types each endpoint keeps one row, whose link_type is its kind's own.
    """
    own = endpoints.where(F.col("interface_role").isin(role, "both") & (F.coalesce("signature", F.lit("")) != ""))
    if with_types:
        return own.join(compatibility(endpoints), "interface_kind")
    return own.withColumn("link_type", F.when(F.col("interface_kind").isin(*M.LINK_TYPES), F.col("interface_kind")).otherwise("rpc"))


def with_patterns(endpoints: DataFrame) -> DataFrame:
    """A row for every search pattern of an endpoint for its link_type, numbered in order."""
    made = endpoints.withColumn("pats", build_patterns(F.col("signature"), F.col("signature_aliases"), F.col("link_type")))
    return made.select("*", F.posexplode("pats").alias("pattern_ord", "pattern")).drop("pats")


def with_trigrams(df: DataFrame, text: str) -> DataFrame:
    """A row for each distinct run of three characters (``key``) of a text, case aside; shorter texts have none."""
    chars = df.withColumn("_c", F.split(F.lower(text), ""))  # a column of its own: made once a row, not once a character
    runs = chars.withColumn("_t", F.transform("_c", lambda x, i: F.concat(x, F.get("_c", i + 1), F.get("_c", i + 2))))
    return runs.withColumn("key", F.explode(F.array_distinct(F.filter("_t", lambda x: x.isNotNull())))).drop("_c", "_t")


def containing(lines: DataFrame, patterns: DataFrame, cap: int = M.MAX_MATCHES) -> DataFrame:
    """(repo, file, line_no, line, pattern): the first ``cap`` lines of each file that hold each pattern of its repository.

    ``patterns`` is (repo, pattern): where to look for what.
    """
    p = settled(patterns.select("repo", "pattern").distinct())
    if p.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        hit = lines.join(F.broadcast(p), "repo").where(line_matches(F.col("line"), F.col("pattern")))
    else:
        place = ["repo", "file", "line_no"]
        cut = with_trigrams(lines, "line").select(*place, "key")  # places alone are shuffled with the keys, not texts
        counts = cut.groupBy("repo", "key").agg(F.count("*").alias("n"))
        own = with_trigrams(p, "pattern")
        rare = own.join(counts, ["repo", "key"], "left").groupBy("repo", "pattern").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), F.col("key"))).alias("key"))
        maybe = cut.join(rare, ["repo", "key"]).select(*place, "pattern").distinct()
        hit = lines.join(maybe, place).where(line_matches(F.col("line"), F.col("pattern"))).select(*place, "line", "pattern")
        # patterns of one or two characters: by their first
        chars = F.array_distinct(F.split(F.lower("line"), ""))
        short = p.where(F.length("pattern").between(1, 2)).withColumn("key", F.substring(F.lower("pattern"), 1, 1))
        few = lines.withColumn("key", F.explode(chars)).join(short, ["repo", "key"]).drop("key")
        hit = hit.unionByName(few.where(line_matches(F.col("line"), F.col("pattern"))).select(*place, "line", "pattern"))
    w = Window.partitionBy("repo", "file", "pattern").orderBy("line_no")
    return hit.select("repo", "file", "line_no", "line", "pattern").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


_EDGE = ["from_repo", "to_repo", "link_type", "server_node_id", "server_function_name", "server_signature", "client_file", "client_line", "client_snippet", "client_node_id", "client_function_name", "match_kind", "confidence", "direction"]


def _edge(**values: Column) -> list[Column]:
    return [values[c].alias(c) for c in _EDGE]


def forward_links(links: DataFrame, endpoints: DataFrame, lines: DataFrame, auto: bool = False) -> DataFrame:
    """Uses of server signatures in client code; every pattern that hits a line counts. Keeps the endpoint's pattern place.

    ``links`` (from_repo, to_repo, type); with ``auto`` the type is that of the endpoint's kind instead.
    """
    servers = with_patterns(endpoints_for(endpoints, "server", not auto))
    on = servers["repo"] == links["to_repo"]
    aimed = servers.join(links, on if auto else on & (servers["link_type"] == links["type"])).drop("type")
    aimed = settled(aimed)
    hits = containing(lines, aimed.select(F.col("from_repo").alias("repo"), "pattern"))
    found = aimed.drop("repo").join(hits.withColumnRenamed("repo", "from_repo"), ["from_repo", "pattern"])
    return found.select(
        *_edge(from_repo=F.col("from_repo"), to_repo=F.col("to_repo"), link_type=F.col("link_type"), server_node_id=F.col("node_id"), server_function_name=F.col("function_name"), server_signature=F.col("signature"), client_file=F.col("file"), client_line=F.col("line_no"), client_snippet=F.trim("line"), client_node_id=F.lit(""), client_function_name=F.lit(""), match_kind=match_kind(F.col("pattern"), F.col("signature")), confidence=F.lit(CONFIDENCE), direction=F.lit("forward")),
        "pattern_ord",
        "pattern",
    )


def reverse_links(links: DataFrame, endpoints: DataFrame, lines: DataFrame, auto: bool = False) -> DataFrame:
    """Client signatures found in server code, bound to the first server endpoint (by node_id) that they overlap.

    A (client endpoint, pattern) counts once: its snippet is the first hit in the first file by path.
    """
    clients = with_patterns(endpoints_for(endpoints, "client", not auto))
    on = clients["repo"] == links["from_repo"]
    aimed = settled(clients.join(links, on if auto else on & (clients["link_type"] == links["type"])).drop("type", "repo"))
    hits = containing(lines, aimed.select(F.col("to_repo").alias("repo"), "pattern"))
    first = hits.groupBy("repo", "pattern").agg(F.min_by("line", F.struct("file", "line_no")).alias("snippet"))
    found = aimed.join(first.withColumnRenamed("repo", "to_repo"), ["to_repo", "pattern"])
    servers = endpoints_for(endpoints, "server", not auto)
    servers = servers.select(F.col("repo").alias("to_repo"), F.col("node_id").alias("s_id"), F.col("function_name").alias("s_name"), F.col("signature").alias("s_sig"), F.col("signature_aliases").alias("s_alias"), F.col("link_type").alias("s_type"))
    match = ["to_repo"] if auto else ["to_repo", "link_type"]
    servers = servers if auto else servers.withColumnRenamed("s_type", "link_type")
    # an overlap is containment either way; repositories and types are the equi-join's keys
    both = found.join(servers, match).where(overlaps(F.col("pattern"), F.col("s_sig"), F.col("s_alias")))
    keys = ["from_repo", "to_repo", "link_type", "node_id", "file_path", "start_line", "pattern_ord", "pattern", "snippet"]
    best = both.groupBy(*keys).agg(F.min_by(F.struct("s_id", "s_name", "s_sig"), "s_id").alias("s"))
    return best.select(
        *_edge(from_repo=F.col("from_repo"), to_repo=F.col("to_repo"), link_type=F.col("link_type"), server_node_id=F.col("s.s_id"), server_function_name=F.col("s.s_name"), server_signature=F.col("s.s_sig"), client_file=F.col("file_path"), client_line=F.col("start_line"), client_snippet=F.trim("snippet"), client_node_id=F.lit(""), client_function_name=F.lit(""), match_kind=F.lit("reverse"), confidence=F.lit(CONFIDENCE), direction=F.lit("reverse")),
        "pattern_ord",
        "pattern",
    )


def find_links(links: DataFrame, endpoints: DataFrame, lines: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Candidates for declared links, repeats included. A link needs a compatible server endpoint for either direction."""
    out = forward_links(links, endpoints, lines)
    return out.unionByName(reverse_links(links, endpoints, lines)) if bidirectional else out


DEDUP = ["from_repo", "to_repo", "link_type", "server_node_id", "client_file", "client_line"]


def keep_first(edges: DataFrame) -> DataFrame:
    """The first of the edges with equal ends, type and place: forward before reverse, then by endpoint and pattern."""
    w = Window.partitionBy(*DEDUP).orderBy("direction", "pattern_ord", "pattern", "client_snippet")
    return edges.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def auto_links(repos: DataFrame, endpoints: DataFrame, lines: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Links between all ordered pairs of repositories that have anything to link, without repeats.

    Pairs are formed only between repositories with source text and such with server endpoints.
    """
    servers = endpoints_for(endpoints, "server", False).select(F.col("repo").alias("to_repo")).distinct()
    pairs = repos.select(F.col("name").alias("from_repo")).distinct().join(servers, F.col("from_repo") != F.col("to_repo"))
    pairs = settled(pairs.withColumn("type", F.lit("")))
    found = forward_links(pairs, endpoints, lines, auto=True)
    if bidirectional:
        found = found.unionByName(reverse_links(pairs, endpoints, lines, auto=True))
    return keep_first(found)


def authoritative_links(links: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A row for every pair of compatible endpoints whose signatures overlap; a link without any gets one bare row."""
    # equal signatures overlap alike: they are tested once for each pair of their classes, and rows are made for hits alone
    def side(role: str, repo: str, p: str) -> tuple[DataFrame, DataFrame]:
        own = endpoints_for(endpoints, role).select(F.col("repo").alias(repo), F.col("link_type").alias("type"), *(F.col(c).alias(f"{p}_{c}") for c in ("node_id", "function_name", "signature", "signature_aliases", "file_path", "start_line")))
        return classed(own, [repo, "type", f"{p}_signature", f"{p}_signature_aliases"], f"{p}_cid")

    (s, s_classes), (c, c_classes) = side("server", "to_repo", "s"), side("client", "from_repo", "c")
    numbered = settled(links.withColumn("link_no", F.monotonically_increasing_id()))
    pairs = numbered.join(s_classes, ["to_repo", "type"]).join(c_classes, ["from_repo", "type"])
    near = overlaps(F.col("s_signature"), F.col("c_signature"), F.col("c_signature_aliases")) | overlaps(F.col("c_signature"), F.col("s_signature"), F.col("s_signature_aliases"))
    hit = settled(pairs.where(near).select("link_no", "from_repo", "to_repo", "type", "s_cid", "c_cid"))
    rows = hit.join(s.drop("to_repo", "type", "s_signature_aliases"), "s_cid").join(c.select("c_cid", "c_node_id", "c_function_name", "c_file_path", "c_start_line"), "c_cid").drop("s_cid", "c_cid", "link_no")
    out = rows.unionByName(numbered.join(hit, "link_no", "left_anti").select("from_repo", "to_repo", "type"), allowMissingColumns=True)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(*_edge(from_repo=F.col("from_repo"), to_repo=F.col("to_repo"), link_type=F.col("type"), server_node_id=text("s_node_id"), server_function_name=text("s_function_name"), server_signature=text("s_signature"), client_file=text("c_file_path"), client_line=F.coalesce("c_start_line", F.lit(0)), client_snippet=F.lit(""), client_node_id=text("c_node_id"), client_function_name=text("c_function_name"), match_kind=F.lit("authoritative"), confidence=F.lit("high"), direction=F.lit("authoritative")))


def classed(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their class, which are those with equal keys, and the classes."""
    rows = settled(rows)
    classes = settled(rows.select(*keys).distinct().withColumn(name, F.monotonically_increasing_id()))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}"))
    return settled(rows.alias("r").join(classes.alias("k"), same).select("r.*", name)), classes


def overlapping_pairs(endpoints: DataFrame) -> DataFrame:
    """(repo, interface_kind, pairs): how many ordered pairs of node_ids a < b of one kind there are where a's signature overlaps b's or an alias of it.

    Signatures are compared by class; the pairs of two classes are counted by walking their members once, in order.
    """
    group = ["repo", "interface_kind"]
    members, classes = classed(endpoints.select(*group, "node_id", "signature", "signature_aliases").where("node_id is not null"), [*group, "signature", "signature_aliases"], "cid")
    a, b = classes.select(*group, F.col("cid").alias("a"), F.col("signature").alias("p")), classes.withColumnRenamed("cid", "b")
    near = settled(a.join(b, group).where(overlaps(F.col("p"), F.col("signature"), F.col("signature_aliases"))).select(*group, "a", "b"))
    own = members.select("cid", "node_id")
    left, right = (near.join(own.withColumnRenamed("cid", c), c).select(*group, "a", "b", "node_id", F.lit(first).alias("first")) for c, first in (("a", 1), ("b", 0)))
    before = Window.partitionBy("a", "b").orderBy("node_id", "first").rowsBetween(Window.unboundedPreceding, -1)  # of equal ids b comes first
    sums = left.unionByName(right).withColumn("n", F.coalesce(F.sum("first").over(before), F.lit(0))).where("first = 0")
    return sums.groupBy(*group).agg(F.sum("n").alias("pairs")).where("pairs > 0")


def links_with_edges(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared links with how many edges each has; edges of undeclared links don't appear."""
    sums = edges.groupBy("from_repo", "to_repo", F.col("link_type").alias("type")).agg(F.count("*").alias("edges"))
    return links.join(sums, ["from_repo", "to_repo", "type"], "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
