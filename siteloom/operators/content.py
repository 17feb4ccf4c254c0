"""Content of pages: repeated blocks and their labels, services, testimonials, questions, people, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions.once import let
from siteloom.operators.intervals import covered, enclosing, so_far
from siteloom.operators.pages import NAV_WORDS, PAGE, attr, main_node
from siteloom.operators.state import written

#: Words of blocks that list services, and of those that list people.
SERVICE_WORDS = "service|offering|what we do|solution|treatment|specialt|product|package|program"
TEAM_WORDS = "team|staff|our people|meet|doctors|attorneys|agents|stylists|technicians"


def signature() -> Column:
    """A node's tag and first two classes."""
    return F.concat_ws(".", "tag", F.array_join(F.sort_array(F.slice("classes", 1, 2)), "."))


def repeated_blocks(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(site, page_id, block_id, block_last, parent_id, classes, html_id, signature, items): containers of the main content with like children.

    Children are alike in tag and first two classes. At least three of them hold more than 12 characters. A container
    that holds another one with as many items goes.
    """
    boxes = nodes.where(F.col("tag").isin("div", "ul", "ol", "section", "tbody", "tr")).join(main_node(nodes), PAGE).where(F.col("node_id").between(F.col("m_id"), F.col("m_last")))
    boxes = boxes.select(*PAGE, F.col("node_id").alias("block_id"), F.col("last_id").alias("block_last"), "parent_id", "classes", attr("id").alias("html_id"))
    child = nodes.where(~F.col("tag").isin("script", "style", "br", "hr")).select(
        *PAGE, F.col("parent_id").alias("block_id"), "sib", signature().alias("signature"), (F.coalesce(F.length("text"), F.lit(5000)) > 12).alias("says"))
    counts = child.groupBy(*PAGE, "block_id", "signature").agg(F.count("*").alias("items"), F.count_if("says").alias("saying"), F.min("sib").alias("first"))
    top = counts.groupBy(*PAGE, "block_id").agg(F.min_by(F.struct("signature", "items", "saying"), F.struct((-F.col("items")).alias("n"), "first")).alias("t")).select(*PAGE, "block_id", "t.*")
    good = boxes.join(top.where((F.col("items") >= least) & (F.col("saying") >= least)), [*PAGE, "block_id"])
    spans = good.select(*PAGE, F.col("block_id").alias("o_id"), F.col("block_last").alias("o_last"), F.col("items").alias("o_items"))
    nested = enclosing(good.select(*PAGE, F.col("block_id").alias("node_id"), "items"), spans, strict=True).where(F.col("items") >= F.col("o_items"))
    return good.join(nested.select(*PAGE, F.col("o_id").alias("block_id")), [*PAGE, "block_id"], "left_anti").select(*PAGE, "block_id", "block_last", "parent_id", "classes", "html_id", "signature", "items")


def block_labels(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """blocks with `label`: the nearest heading among the container's preceding siblings, else among its parent's.

    A sibling that is no heading itself speaks by the first h1 in it, else h2, else h3. The next heading of each kind is carried back
    through a page, and what siblings say forward along them.
    """
    back = so_far(order=F.desc("node_id"), own=False)
    ahead = [F.last(F.when(F.col("tag") == h, F.struct("node_id", "text")), ignorenulls=True).over(back) for h in ("h1", "h2", "h3")]
    says = F.coalesce(F.when(F.col("tag").rlike("^h[1-6]$"), F.struct("text")), *[F.when(F.col(f"next{i}.node_id") <= F.col("last_id"), F.struct(F.col(f"next{i}.text").alias("text"))) for i in range(3)])
    heads = nodes.select(*PAGE, "node_id", "parent_id", "last_id", "tag", F.when(F.col("tag").rlike("^h[1-6]$"), F.col("text")).alias("text"))
    said = heads.select("*", *[a.alias(f"next{i}") for i, a in enumerate(ahead)]).withColumn("says", says)
    said = said.select(*PAGE, "node_id", F.last("says", ignorenulls=True).over(so_far("parent_id", own=False))["text"].alias("label"))
    of = lambda key, name: said.select(*PAGE, F.col("node_id").alias(key), F.col("label").alias(name))
    out = blocks.join(of("block_id", "near"), [*PAGE, "block_id"], "left").join(of("parent_id", "far"), [*PAGE, "parent_id"], "left")
    return out.select(*blocks.columns, F.lower(F.coalesce("near", "far", F.lit(""))).alias("label"))


def labelled_blocks(nodes: DataFrame) -> DataFrame:
    """The labelled blocks of pages, found once and written, since several branches of a plan read them."""
    return written(block_labels(written(repeated_blocks(nodes), "blocks"), nodes), "labelled")


def block_items(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site, page_id, block_id, items, item_id, name, paragraphs, image, link): the like children of labelled blocks."""
    child = nodes.select(*PAGE, F.col("parent_id").alias("block_id"), F.col("node_id").alias("o_id"), F.col("last_id").alias("o_last"), signature().alias("signature"))
    items = blocks.select(*PAGE, "block_id", "signature", "items").join(child, [*PAGE, "block_id", "signature"])
    rank = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")).when(F.col("tag") == "strong", 7).when(F.col("tag") == "b", 8).when(
        F.array_contains("classes", "title"), 9).when(F.array_contains("classes", "heading"), 10)
    parts = nodes.select(*PAGE, "node_id", "tag", F.when(rank.isNotNull() | (F.col("tag") == "p"), F.col("text")).alias("text"), attr("src").alias("src"), attr("href").alias("href"), rank.alias("rank"))
    parts = parts.where(F.col("rank").isNotNull() | F.col("tag").isin("p", "img", "a"))
    whole = enclosing(parts, items.select(*PAGE, "o_id", "o_last", "block_id", "items"))
    found = whole.groupBy(*PAGE, "block_id", "o_id").agg(
        F.min_by("text", F.when(F.col("rank").isNotNull(), F.struct("rank", "node_id"))).alias("name"),
        F.transform(F.sort_array(F.collect_list(F.when((F.col("tag") == "p") & (F.col("text") != ""), F.struct("node_id", "text")))), lambda x: x["text"]).alias("paragraphs"),
        F.min_by("src", F.when(F.col("tag") == "img", F.col("node_id"))).alias("image"), F.min_by("href", F.when(F.col("tag") == "a", F.col("node_id"))).alias("link"))
    out = items.select(*PAGE, "block_id", "items", "o_id").hint("merge").join(found, [*PAGE, "block_id", "o_id"], "left")
    return out.select(*PAGE, "block_id", "items", F.col("o_id").alias("item_id"), T.humanize_heading(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs"), "image", "link")


def _named(most: int) -> Column:
    """Whether `name` is a heading of at most so many characters that no menu has; as one expression, which is written once where a filter is pushed to."""
    return let(F.col("name"), lambda n: (n != "") & ~n.rlike(NAV_WORDS) & (F.length(n) <= most))


def page_services(nodes: DataFrame, most: int = 24, blocks: DataFrame | None = None) -> DataFrame:
    """(site, page_id, ord, name, summary): items of blocks that speak of services until there are three, else links to service pages.

    blocks: the labelled blocks of the pages, if they are known.
    """
    blocks = labelled_blocks(nodes) if blocks is None else blocks
    named = F.lower(F.concat_ws(" ", "label", F.array_join("classes", " "), "html_id"))
    items = block_items(blocks.where(named.rlike(SERVICE_WORDS)), nodes).where(_named(90))
    before = F.rank().over(Window.partitionBy(*PAGE).orderBy(F.desc("items"), "block_id")) - 1  # items of the blocks before
    found = items.withColumn("before", before).where("before < 3")
    summary = F.coalesce(F.get(F.filter("paragraphs", lambda p: p != F.col("name")), F.lit(0)), F.lit(""))
    rows = found.select(*PAGE, F.struct(F.lit(0).alias("a"), (-F.col("items")).alias("b"), F.col("block_id").alias("c"), F.col("item_id").alias("d")).alias("at"), "name", summary.alias("summary"))
    href = F.trim(attr("href"))
    links = nodes.where((F.col("tag") == "a") & href.rlike("(?i)service|treatment|what-we-do") & ~href.rlike("(?i)^(mailto|tel|sms|javascript):"))
    links = links.select(*PAGE, F.struct(F.lit(1).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("c"), F.col("node_id").alias("d")).alias("at"), T.humanize_heading(F.col("text")).alias("name"), F.lit("").alias("summary"))
    links = links.where(_named(70)).where(~F.col("name").rlike("(?i)@|^https?:"))
    named_so = F.count_if(F.col("at.a") == 0).over(Window.partitionBy(*PAGE))
    both = rows.unionByName(links).withColumn("n", named_so).where((F.col("at.a") == 0) | (F.col("n") < 2))
    first = both.groupBy(*PAGE, T.slug(F.col("name")).alias("key")).agg(F.min(F.struct("at", "name", "summary")).alias("f"))
    return first.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("f.at")).alias("ord"), "f.name", "f.summary").where(F.col("ord") <= most)


def page_team(nodes: DataFrame, most: int = 20, blocks: DataFrame | None = None) -> DataFrame:
    """(site, page_id, ord, name, role, bio): people of the largest block that speaks of a team."""
    blocks = labelled_blocks(nodes) if blocks is None else blocks
    named = F.lower(F.concat_ws(" ", "label", F.array_join("classes", " ")))
    items = block_items(blocks.where(named.rlike(TEAM_WORDS)), nodes).where(_named(60))
    largest = F.rank().over(Window.partitionBy(*PAGE).orderBy(F.desc("items"), "block_id"))
    role = F.when(T.word_count(F.col("paragraphs")[0]) <= 8, F.get("paragraphs", F.lit(0)))
    bio = F.get(F.filter("paragraphs", lambda p: T.word_count(p) > 8), F.lit(0))
    own = items.withColumn("nth", largest).where("nth = 1").withColumn("role", F.when(F.size("paragraphs") > 0, role)).withColumn("bio", bio)
    first = own.groupBy(*PAGE, F.lower("name").alias("key")).agg(F.min(F.struct("item_id", "name", "role", "bio")).alias("f"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("f.item_id"))).where(F.col("ord") <= most)
    return ranked.select(*PAGE, "ord", "f.name", F.coalesce("f.role", F.lit("")).alias("role"), F.coalesce("f.bio", F.lit("")).alias("bio"))


#: Words of classes and ids that hold quotes, and of pages that answer questions.
QUOTE_CLASS = "testimonial|review|quote"
FAQ_PAGE = r"(?i)frequently asked|faqs?\b|common questions"


def page_testimonials(nodes: DataFrame, most: int = 30) -> DataFrame:
    """(site, page_id, ord, quote, author): block quotes, then elements named after quotes that hold none; without their citation, first of equal starts.

    A named element's quote is its first paragraph, or its whole text.
    """
    has = lambda name: F.array_contains("classes", name)
    spans = lambda df, later: df.select(*PAGE, F.col("node_id").alias("o_id"), F.col("last_id").alias("o_last"), F.lit(later).alias("later"), "text")
    quotes = spans(nodes.where("tag = 'blockquote'"), 0)
    named = spans(nodes.where(F.array_join("classes", " ").rlike(QUOTE_CLASS) | F.coalesce(attr("id").rlike("testimonial"), F.lit(False))), 1)
    holding = enclosing(quotes.select(*PAGE, F.col("o_id").alias("node_id")), named.select(*PAGE, "o_id", "o_last"), strict=True).select(*PAGE, "o_id")
    named = named.join(holding, [*PAGE, "o_id"], "left_anti")
    first_p = enclosing(nodes.where("tag = 'p'").select(*PAGE, "node_id", F.col("text").alias("p")), named.select(*PAGE, "o_id", "o_last"), strict=True).groupBy(*PAGE, "o_id").agg(F.min_by("p", "node_id").alias("p"))
    named = named.join(first_p, [*PAGE, "o_id"], "left").withColumn("text", F.coalesce("p", "text")).drop("p")
    short = F.when(F.col("tag") == "cite", 0).when(F.col("tag") == "footer", 1).when(has("author"), 2).when(has("name"), 3)
    wide = F.when(F.col("tag") == "cite", 0).when(has("author"), 1).when(has("name"), 2).when(has("customer"), 3).when(F.col("tag").isin("footer", "h4", "h5", "strong"), 4)
    cites = nodes.select(*PAGE, "node_id", F.col("text").alias("cite"), short.alias("short"), wide.alias("wide")).where("short is not null or wide is not null")
    both = quotes.unionByName(named)
    rank = F.when(F.col("later") == 0, F.col("short")).otherwise(F.col("wide"))
    author = enclosing(cites, both.select(*PAGE, "o_id", "o_last", "later"), strict=True).where(rank.isNotNull()).groupBy(*PAGE, "o_id", "later").agg(F.min_by("cite", F.struct(rank.alias("r"), "node_id")).alias("cite"))
    rows = both.join(author, [*PAGE, "o_id", "later"], "left")
    text = F.when(F.coalesce("cite", F.lit("")) != "", F.replace("text", F.col("cite"), F.lit(""))).otherwise(F.col("text"))
    text = F.regexp_replace(T.squash(text), "^[\"“”']+|[\"“”']+$", "")
    rows = rows.select(*PAGE, "later", "o_id", text.alias("quote"), F.regexp_replace(T.squash(F.col("cite")), r"^[-–—\s]+", "").alias("author")).where(F.length("quote").between(25, 900))
    first = rows.groupBy(*PAGE, F.lower(F.substring("quote", 1, 60)).alias("key")).agg(F.min(F.struct("later", "o_id", "quote", "author")).alias("f"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("f.later", "f.o_id"))).where(F.col("ord") <= most).select(*PAGE, "ord", "f.quote", "f.author")


def page_faqs(nodes: DataFrame, most: int = 25) -> DataFrame:
    """(site, page_id, ord, question, answer): terms with definitions, then questions in the main content with what follows them.

    A question is a heading, a summary, or an element named so or titled in an accordion, that ends in a question mark; headings of level 2 count
    on pages of questions only. The next sibling with text answers it unless a heading comes first; a summary's answer is the rest of its parent.
    """
    order = Window.partitionBy(*PAGE, "parent_id").orderBy("sib")
    by = so_far("parent_id", order=F.desc("sib"), own=False)  # the siblings after a node, the next one last
    folded = F.array_join("classes", " ").contains("accordion")
    tells = F.col("tag").rlike("^h[1-6]$") | F.col("text").isNull() | (F.col("text") != "")  # no text is kept where it is long: too long for an answer, but the next one all the same
    rows = nodes.select(*PAGE, "parent_id", "node_id", "last_id", "tag", "classes", "text", F.lead("tag").over(order).alias("next_tag"), F.lead("text").over(order).alias("next_text"),
                        F.last(F.when(tells, F.struct("tag", "text")), ignorenulls=True).over(by).alias("then"),
                        (covered(folded, strict=True) & F.array_join("classes", " ").contains("title")).alias("titled"))
    terms = rows.where("tag = 'dt' and next_tag = 'dd'").select(*PAGE, F.lit(0).alias("rank"), "node_id", F.col("text").alias("question"), F.col("next_text").alias("answer"))
    about = main_node(nodes, faq_page=F.col("text").rlike(FAQ_PAGE))
    near = rows.where(F.col("text").rlike(r"\?\s*$")).join(about, PAGE).where(F.col("node_id").between(F.col("m_id"), F.col("m_last")))
    asks = near.where(F.col("tag").isin("h3", "h4", "h5", "summary") | F.array_contains("classes", "question") | F.col("titled") | ((F.col("tag") == "h2") & F.col("faq_page")))
    parents = nodes.select(*PAGE, F.col("node_id").alias("parent_id"), F.col("text").alias("parent_text"))
    asked = asks.join(parents, [*PAGE, "parent_id"], "left")
    rest = F.expr("overlay(parent_text placing '' from greatest(locate(text, parent_text), 1) for if(locate(text, parent_text) > 0, length(text), 0))")
    answer = F.when(F.col("tag") == "summary", T.squash(rest)).when(~F.col("then.tag").rlike("^h[1-6]$"), F.col("then.text"))
    heads = asked.select(*PAGE, F.lit(1).alias("rank"), "node_id", F.col("text").alias("question"), answer.alias("answer"))
    good = (F.col("question") != "") & (F.length("question") <= 200) & F.length("answer").between(10, 1500) & (F.col("question").endswith("?") | (T.word_count(F.col("question")) <= 14))
    first = terms.unionByName(heads).where(good).groupBy(*PAGE, F.lower("question").alias("key")).agg(F.min(F.struct("rank", "node_id", "question", "answer")).alias("f"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("f.rank", "f.node_id"))).where(F.col("ord") <= most).select(*PAGE, "ord", "f.question", "f.answer")
