"""Page elements as a table, and rules that are joined with it.

A page becomes one row per element: its number in document order, the number of its last descendant, its place in the page's
text, tag, classes, id and attributes. A rule is rows too, one for each step of its path: (site, rule, step, key and what else
the element must have). Elements meet steps in an equi-join on site and key, the tag or else a class, an id or an attribute, so
an element only meets the few steps that name something it has. Whether an element stands inside one of an outer step is told
by a running maximum of interval ends in document order, since the intervals of a page are nested or apart: no pairs are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions import markup
from postlake.session import materialize

_STEP = re.compile(r"""([a-z0-9]*)((?:\.[\w-]+)*)(?:#([\w-]+))?(?:\[([\w-]+)(?:(\*?)="([^"]*)")?\])?""")
_RULES = (
    "site string, field string, priority int, rule int, steps int, step int, key string, "
    "r_tag string, r_classes array<string>, r_id string, r_attribute string, r_part boolean, r_value string"
)
_ELEMENTS = (
    "page_no bigint, site string, number int, last int, begin int, end int, tag string, classes array<string>, "
    "attributes map<string,string>, text string"
)


def rule_rows(rules: Iterable[tuple[str | None, str, int, str]]) -> list[tuple]:
    """Rows of the rule table from (site, field, priority, paths): comma-separated paths count alike, blanks part their steps.

    A step is a tag, classes, an id and an attribute that is there, equals a value or holds it. Without a site a rule holds for
    all pages.
    """
    rows = []
    for site, field, priority, paths in rules:
        for path in paths.split(","):
            steps, rule = path.split(), rows[-1][3] + 1 if rows else 0
            for k, step in enumerate(steps):
                m = _STEP.fullmatch(step)
                if not m:
                    raise ValueError(f"unsupported step {step!r}")
                tag, classes, ident, attribute, part, value = m.groups()
                names = classes.split(".")[1:]
                key = f"t:{tag}" if tag else f"c:{names[0]}" if names else f"i:{ident}" if ident else f"a:{attribute}"
                rows.append((site, field, priority, rule, len(steps), k, key, tag or None, names, ident, attribute, bool(part), value))
    return rows


def element_table(pages: DataFrame) -> DataFrame:
    """(page_no, page, site, number, last, begin, end, tag, classes, attributes, text): the elements of pages(html, ...).

    A page has one more row with number -1, which holds its own columns (without html) as ``page`` and its text.
    """
    kept = [c for c in pages.columns if c != "html"]
    site = F.col("site") if "site" in kept else F.lit(None).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("page_no"), F.struct(*[f"`{c}`" for c in kept]).alias("page"), site.alias("site"), "html")
    schema = T.StructType([T.StructField("page", rows.schema["page"].dataType), *T.StructType.fromDDL(_ELEMENTS).fields])
    names = schema.names[1:]
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 200):
                batch = whole.slice(s, 200)
                columns: list[list] = [[] for _ in names]
                source: list[int | None] = []
                for k, (page_no, of, html) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_no", "site", "html")))):
                    elements, text = markup.elements_of(html or "")
                    source.append(k)
                    found = [(page_no, of, -1, len(elements), 0, len(text), None, None, None, text)]
                    for e in elements:
                        a = e.attributes() if e.source else {}
                        found.append((page_no, of, e.number, e.last, e.begin, e.end, e.tag, a.get("class", "").split(), list(a.items()), None))
                    source += [None] * len(elements)
                    for column, values in zip(columns, zip(*found)):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page").take(pa.array(source, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["page", *names]
                )

    return rows.mapInArrow(run, schema)


def step_hits(elements: DataFrame, rules: list[tuple]) -> DataFrame:
    """Elements with every step that they meet, and the pages' own rows; an equi-join of two tables on site and key."""
    wanted = F.broadcast(elements.sparkSession.createDataFrame(rules, _RULES))  # the rules of the program: some hundred rows
    names = F.map_keys("attributes")
    keys = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("t:"), "tag")), F.transform("classes", lambda c: F.concat(F.lit("c:"), c)),
        F.transform(F.filter(names, lambda n: n == "id"), lambda n: F.concat(F.lit("i:"), F.col("attributes")[n])),
        F.transform(names, lambda n: F.concat(F.lit("a:"), n)),
    ))
    own = elements.where("number >= 0").withColumn("key", F.explode(keys))
    value = F.get(F.map_values(F.map_filter("attributes", lambda n, _: n == F.col("r_attribute"))), F.lit(0))
    fits = (
        (F.col("r_tag").isNull() | (F.col("r_tag") == F.col("tag")))
        & (F.size(F.array_except("r_classes", "classes")) == 0)
        & (F.col("r_id").isNull() | F.coalesce(F.element_at("attributes", "id") == F.col("r_id"), F.lit(False)))
        & (F.col("r_attribute").isNull() | F.coalesce(
            F.when(F.col("r_value").isNull(), value.isNotNull()).when(F.col("r_part"), F.contains(value, F.col("r_value")))
            .otherwise(value == F.col("r_value")), F.lit(False)))
    )
    columns = ["page_no", "number", "last", "begin", "end", "attributes", "field", "priority", "rule", "steps", "step"]
    everywhere = all(r[0] is None for r in rules)
    met = own.drop("site").join(wanted.drop("site"), "key") if everywhere else own.join(wanted, ["site", "key"])
    return met.where(fits).select(*columns)


def landed(pages: DataFrame, rules: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(pages, hits): the pages' own columns and text, and the steps that their elements meet, from one pass over the html."""
    elements, _ = materialize(element_table(pages), "page-elements")
    return elements.where("number = -1").select("page_no", "page", "text"), step_hits(elements, rules)


def whole_paths(hits: DataFrame, rules: list[tuple], scope: list[str]) -> DataFrame:
    """The elements that meet a rule's last step inside elements of its outer steps; ``scope``: columns of what they stand in.

    An element stands inside one of the step before if such an element came before it and ends no earlier: so the greatest end
    so far decides. The frame looks at smaller numbers only.
    """
    so_far = Window.partitionBy(*scope, "rule").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("whole", F.col("step") == 0)
    for k in range(1, max(r[4] for r in rules)):
        reach = F.max(F.when(F.col("whole") & (F.col("step") == k - 1), F.col("last"))).over(so_far)
        hits = hits.withColumn("whole", F.col("whole") | ((F.col("step") == k) & F.coalesce(reach >= F.col("number"), F.lit(False))))
    return hits.where(F.col("whole") & (F.col("step") == F.col("steps") - 1)).drop("whole", "steps", "step")


def with_text(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """``hits`` with the text of each element, cut out of its page's text."""
    own = F.trim(F.substring(F.col("text"), F.col("begin") + 1, F.greatest(F.col("end") - F.col("begin"), F.lit(0))))
    return hits.join(pages.select("page_no", "text"), "page_no").withColumn("said", own).drop("text", "begin", "end")


def inside(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """``hits`` of every card that they stand in: a structural join on the page with ranges; cards: (page_no, card, card_last, ...)."""
    held = cards.withColumnRenamed("page_no", "card_page")
    same = (F.col("page_no") == F.col("card_page")) & (F.col("number") > F.col("card")) & (F.col("number") <= F.col("card_last"))
    return hits.join(held, same).drop("card_page")


def best(field: str, said: str = "said"):
    """The first text that is not empty, by the order of a field's rules and then of the page."""
    order = F.when((F.col("field") == field) & (F.col(said) != ""), F.struct("priority", "number"))
    return F.min_by(said, order)
