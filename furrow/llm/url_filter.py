"""URL filters by rules and by the link graph (operator 13).

Rules decide the urls that they fit. Hosts with mostly allowed urls are
trusted seeds, hosts with mostly blocked ones are blocked seeds. Trust walks
along the links between hosts from the trusted seeds (personalised PageRank),
distrust walks against them from the blocked seeds, so a host that links to
blocked ones is distrusted. A host that has more distrust than trust is
blocked; its urls that no rule fits get that verdict.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import fresh, materialize
from furrow.llm.salting import hot_keys, salted_join

ALLOW, BLOCK = "allow", "block"
#: Rules of the registered query: verdict, host and path.
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]

#: Chance that a walk goes on at a host.
DAMPING = 0.85
#: Share of a host's urls that rules must allow, or block, to make it a seed.
SEED_SHARE = 0.5
#: A blocked host has at least this part of the distrust of a lone seed.
LEAST = 0.01
#: Links that a walk follows at most, and the part of all mass below which
#: walks are no longer followed.
STEPS, REST = 60, 1e-6

# after the first ://, up to a slash, question mark, hash or the end
_HOST = r"^(?s).*?://([^/?#]*)"
_PATH = r"^(?s).*?://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without it and for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def fitting_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. A rule
    fits its host and all hosts below it if the path starts with the rule's
    path. Equal rules with both verdicts block. The list becomes one expression,
    so it is meant for hundreds of rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the last one tried, the longest, is the outermost condition
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK, r[1])):
        where, slash, rest = rule.partition("/")
        below = (host_ == where) | host_.endswith("." + where)
        out = F.when(below & path_.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template|xmp)\b.*?(?:</\1|\Z)", re.S | re.I)
_LINK = re.compile(r"<(a|area|base)(?=[\s/])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_ABSOLUTE = re.compile(r"(?:https?:)?//([^/?#]*)", re.I)
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*:", re.I)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def linked_hosts(page: str | None, own: str) -> set[str]:
    """Other hosts that the links of a page lead to. Links without a host lead
    to that of ``<base>`` or the page's own; ``rel=nofollow`` and other schemes
    than http lead nowhere, nor do links in comments, scripts and the like."""
    base, found = own, set()
    for tag, inside in _LINK.findall(_HIDDEN.sub(" ", page or "")):
        have: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(inside):
            if not value:
                continue
            have.setdefault(name.lower(), entities.unescape(value.strip(value[0] if value[0] in "\"'" else "")))
        if "href" not in have or (tag.lower() != "base" and "nofollow" in have.get("rel", "").lower().split()):
            continue
        link = re.sub(r"[\t\n\r]", "", have["href"].strip("".join(map(chr, range(33))))).replace("\\", "/")
        if m := _ABSOLUTE.match(link):
            to = m[1].translate(_LOWER)
        else:
            to = "" if _SCHEME.match(link) else base
        if tag.lower() == "base":
            base = to or base
        else:
            found.add(to)
    return found - {"", own}


def host_links(pages: DataFrame, from_host: str, html: str = "html") -> DataFrame:
    """``src``, ``dst`` and ``pages``: so many pages of the one host link to
    the other. A page counts once for each host that it links to."""

    def run(rows):
        for b in rows:
            links: Counter[tuple[str, str]] = Counter()
            for own, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                links.update((own, to) for to in linked_hosts(page, own))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in links], pa.string()), pa.array([d for _, d in links], pa.string()),
                                              pa.array(list(links.values()), pa.int64())], names=["src", "dst", "pages"])

    found = pages.where(F.col(from_host) != "").select(from_host, html).mapInArrow(run, "src string, dst string, pages long")
    return found.groupBy("src", "dst").agg(F.sum("pages").alias("pages"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, steps: int = STEPS, rest: float = REST) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of every host that a walk reaches.

    ``seeds`` has host and kind (allow or block), ``links`` src, dst and pages.
    Each seed sends out a walk that ends at a host with chance 1 - ``damping``;
    a host's figure is how many walks end there. Trust leaves a host by its
    links, distrust by the links to it, in proportion to their pages; mass of a
    host without any goes no further. Walks are followed for ``steps`` links, or
    until less than ``rest`` of the mass is on its way, so what is left out is
    below the larger of ``rest`` and damping ** steps. Each step's masses are
    written before the next; hosts with a large share of all links are salted.
    """
    links = materialize(links.where("pages > 0"), "host-links")
    moves = links.select(F.explode(F.array(
        F.struct(F.lit(ALLOW).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "pages"),
        F.struct(F.lit(BLOCK).alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "pages"))).alias("m")).select(
            F.concat("m.kind", F.lit(" "), "m.at").alias("at"), F.concat("m.kind", F.lit(" "), "m.to").alias("to"), "m.pages")
    hot = hot_keys(moves, "at")
    leaving = moves.groupBy("at").agg(F.sum("pages").alias("all"))
    moves = materialize(salted_join(moves, leaving, "at", hot).select("at", "to", (F.col("pages") / F.col("all") * damping).alias("share")), "host-moves")
    now = materialize(seeds.select(F.concat("kind", F.lit(" "), "host").alias("at")).groupBy("at").agg(F.lit(1.0).alias("mass")), "host-mass")
    walked, start = now, F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass")
    mass = least = now.agg(start).first()["mass"]
    for _ in range(steps):
        if mass <= rest * least:
            break
        gone = salted_join(moves, now, "at", hot).groupBy("to").agg(F.sum(F.col("share") * F.col("mass")).alias("mass"))
        now = materialize(gone.select(F.col("to").alias("at"), "mass"), "host-mass")
        walked, mass = walked.unionByName(now), now.agg(start).first()["mass"]
    ended = F.sum(F.col("mass") * (1 - damping))
    total = walked.groupBy("at").agg(ended.alias("mass")).select(F.split("at", " ", 2).alias("at"), "mass")
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("at")[0] == kind, F.col("mass"))), F.lit(0.0))
    return total.groupBy(F.col("at")[1].alias("host")).agg(side(ALLOW).alias("trust"), side(BLOCK).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seed_share: float = SEED_SHARE, damping: float = DAMPING,
          least: float = LEAST, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits), ``verdict``,
    ``trust`` and ``distrust`` to every page; columns of those names are
    replaced, ``html`` is left out.

    The verdict is that of the longest fitting rule. Without one it is block
    if the host's distrust is above its trust and at least ``least`` times what
    a lone seed keeps (1 - ``damping``), else allow; so it is for hosts that no
    walk reaches and for urls without a host (null and those without ``://``).
    A page with null or empty html has no links. Rows that repeat count as
    often as they occur; an empty table gives an empty table.
    """
    added = ("host", "path", "rule", "verdict", "trust", "distrust")
    kept = [c for c in pages.columns if c.lower() not in added and c != html]
    own = fresh(pages, "__host")
    links = host_links(pages.select(host(F.col(url)).alias(own), html), own, html)
    rows = pages.select(*kept, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    fits = fresh(rows, "__fits")
    rows = materialize(rows.withColumn(fits, fitting_rule(F.col("host"), F.col("path"), rules)), "url-rules")
    share = lambda v: F.count_if(F.col(f"{fits}.verdict") == v) / F.count("*")
    per_host = rows.where("host <> ''").groupBy("host").agg(share(ALLOW).alias(ALLOW), share(BLOCK).alias(BLOCK))
    kinds = F.explode(F.array(*[F.when((F.col(v) > 0) & (F.col(v) >= seed_share), F.lit(v)) for v in (ALLOW, BLOCK)]))
    seeds = per_host.select("host", kinds.alias("kind")).where("kind is not null")
    judged = materialize(propagate(seeds, links, damping), "host-verdicts")
    rows = salted_join(rows, judged, "host", hot_keys(rows, "host"), how="left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    by_links = F.when((distrust > trust) & (distrust >= least * (1 - damping)), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return rows.select(*kept, "host", "path", F.col(f"{fits}.rule").alias("rule"), F.coalesce(F.col(f"{fits}.verdict"), by_links).alias("verdict"),
                       trust.alias("trust"), distrust.alias("distrust"))
