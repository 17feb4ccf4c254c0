"""Images of pages and their roles; a site's logo, hero, gallery and the files to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.functions.once import found
from siteloom.operators.pages import PAGE, attr

#: Hosts of trackers, names of spacers, and words that give an image its role, first match first.
TRACKING_HOSTS = r"(?i)doubleclick|google-analytics|googletagmanager|facebook\.com/tr|scorecardresearch|quantserve|hotjar|pixel|beacon"
JUNK_NAME = r"(?i)^(spacer|blank|clear|pixel|1x1|dot|shim|transparent|loading|placeholder|arrow|bullet|divider|separator|bg-?\d*)\.(gif|png|jpe?g)$"
ROLES = (
    ("logo", "logo|brand(mark)?|wordmark"), ("icon", "icon|sprite|badge|award|cert|seal|star|social|facebook|instagram|twitter"), ("hero", "hero|banner|slide|masthead|header-image|jumbotron"),
    ("team", "team|staff|headshot|portrait|profile|avatar"), ("gallery", "gallery|portfolio|project|work|before|after|photo"),
)
HERO_WORDS = "hero|banner|jumbotron|masthead|slide"
BACKGROUND = r"""(?i)background(?:-image)?\s*:[^;]*url\((['"]?)([^'")]+)\1\)"""
SOURCES = ("src", "data-src", "data-lazy-src", "data-original")
SETS = ("srcset", "data-srcset", "data-lazy-srcset")
GALLERY_MOST, ASSETS_MOST = 24, 40


def widest(srcset: Column) -> Column:
    """The candidate of a srcset with the largest width, or density in thousands; the first of equal ones."""
    def scored(part: Column, i: Column) -> Column:
        words = F.split(F.trim(part), r"\s+")
        given = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
        width = F.regexp_extract(given, r"(\d+)w", 1).try_cast("double")
        density = F.regexp_extract(given, r"([\d.]+)x", 1).try_cast("double")
        return F.struct((-F.coalesce(F.nullif(width, F.lit(0.0)), F.coalesce(density, F.lit(1.0)) * 1000)).alias("s"), i.alias("i"), F.get(words, F.lit(0)).alias("url"))

    return F.when(F.coalesce(srcset, F.lit("")) != "", F.array_min(F.transform(F.split(srcset, ","), scored))["url"])


def role(haystack: Column, width: Column, height: Column) -> Column:
    small = width.between(1, 64) & height.between(1, 64)
    return F.coalesce(*[F.when(haystack.rlike(words), F.lit(name)) for name, words in ROLES], F.when(small, F.lit("icon")), F.lit("content"))


def page_images(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site, page_id, node_id, url, alt, title, width, height, role): usable images of each page, the first of each address.

    The first source that isn't embedded data counts, then the widest of the srcsets. Trackers, spacers and images of one or two pixels
    go. Backgrounds in style attributes follow the images.
    """
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    base = pages.select(*PAGE, F.col("url").alias("base"))
    chosen = F.get(F.filter(F.array(*[attr(a) for a in SOURCES], *[widest(attr(a)) for a in SETS]), lambda s: (F.coalesce(s, F.lit("")) != "") & ~F.startswith(s, F.lit("data:"))), F.lit(0))
    size = lambda a: F.nullif(attr(a).try_cast("int"), F.lit(0))
    words = F.lower(F.concat_ws(" ", F.coalesce(attr("alt"), F.lit("")), F.coalesce(attr("class"), F.lit("")), F.coalesce(attr("id"), F.lit(""))))
    imgs = nodes.where("tag = 'img'").select(*PAGE, "node_id", T.squash(attr("alt")).alias("alt"), T.squash(attr("title")).alias("title"), size("width").alias("width"), size("height").alias("height"), words.alias("words"), found(chosen, lambda s: s.isNotNull()).alias("src"))
    imgs = imgs.where(~F.coalesce(F.col("width") <= 2, F.lit(False)) & ~F.coalesce(F.col("height") <= 2, F.lit(False)))
    address = lambda rule: found(U.absolute(F.col("src"), F.col("base")), rule)
    imgs = imgs.join(base, PAGE).withColumn("url", address(lambda u: u.isNotNull() & ~u.rlike(TRACKING_HOSTS) & ~U.basename(u).rlike(JUNK_NAME)))
    imgs = imgs.select(*PAGE, F.lit(0).alias("later"), "node_id", "url", "alt", "title", "width", "height", role(F.concat_ws(" ", "words", F.lower("url")), F.col("width"), F.col("height")).alias("role"))
    none = F.lit(None).cast("int")
    styled = nodes.where(F.contains(attr("style"), F.lit("background"))).select(*PAGE, "node_id", F.regexp_extract(attr("style"), BACKGROUND, 2).alias("src"), F.lower(F.array_join("classes", " ")).alias("words")).where("src <> ''")
    styled = styled.join(base, PAGE).withColumn("url", address(lambda u: u.isNotNull() & U.is_image(u) & ~u.rlike(TRACKING_HOSTS)))
    styled = styled.select(*PAGE, F.lit(1).alias("later"), "node_id", "url", F.lit("").alias("alt"), F.lit("").alias("title"), none.alias("width"), none.alias("height"), F.when(F.col("words").rlike(HERO_WORDS), "hero").otherwise("background").alias("role"))
    each = imgs.unionByName(styled)
    first = each.groupBy(*PAGE, "url").agg(F.min_by(F.struct("later", "node_id", "alt", "title", "width", "height", "role"), F.struct("later", "node_id")).alias("f"))
    return first.select(*PAGE, "url", "f.*")


def site_images(images: DataFrame) -> DataFrame:
    """(site, ord, url, alt, title, width, height, role): the images of a site, the first of each address, in the order of pages."""
    place = F.struct("page_id", "later", "node_id")
    first = images.groupBy("site", "url").agg(F.min(place).alias("at"), F.min_by(F.struct("alt", "title", "width", "height", "role"), place).alias("f"))
    return first.select("site", F.row_number().over(Window.partitionBy("site").orderBy("at")).alias("ord"), "url", "f.*")


def logo_pick(pages: DataFrame, nodes: DataFrame, images: DataFrame) -> DataFrame:
    """(site, url, alt): the first image with the role, else the first in the first page's header, else the one in a link home. images: site_images()."""
    first_page = pages.groupBy("site").agg(F.min("page_id").alias("page_id"))
    own = nodes.join(first_page, PAGE, "left_semi")
    rank = F.when(F.col("tag") == "header", 0).when(F.array_contains("classes", "header"), 1).when(attr("id") == "header", 1).when(F.array_contains("classes", "site-header"), 1).when(F.array_contains("classes", "navbar"), 1)
    header = own.select("site", "node_id", "last_id", rank.alias("r")).where("r is not null").groupBy("site").agg(F.min_by(F.struct(F.col("node_id").alias("a"), F.col("last_id").alias("b")), F.struct("r", "node_id")).alias("span"), F.lit(1).alias("step"))
    home = own.where((F.col("tag") == "a") & ((attr("href") == "/") | (attr("rel") == "home"))).select("site", F.struct(F.col("node_id").alias("a"), F.col("last_id").alias("b")).alias("span"), F.lit(2).alias("step"))
    src = F.coalesce(F.nullif(attr("src"), F.lit("")), F.when(F.col("step") == 1, attr("data-src")))
    imgs = own.where("tag = 'img'").join(header.unionByName(home), "site").where(F.col("node_id").between(F.col("span.a"), F.col("span.b"))).select("site", "step", "node_id", src.alias("src"), T.squash(attr("alt")).alias("alt"))
    base = pages.join(first_page, PAGE, "left_semi").select("site", F.col("url").alias("base"))
    firsts = imgs.groupBy("site", "step").agg(F.min_by(F.struct("src", "alt"), "node_id").alias("i")).join(base, "site").select("site", "step", U.absolute(F.col("i.src"), F.col("base")).alias("url"), F.col("i.alt").alias("alt")).where("url is not null")
    known = firsts.join(images.select("site", "url", F.col("alt").alias("known_alt")), ["site", "url"], "left").select("site", "step", F.lit(0).alias("ord"), "url", F.coalesce("known_alt", "alt").alias("alt"))
    tagged = images.where("role = 'logo'").select("site", F.lit(0).alias("step"), "ord", "url", "alt")
    best = tagged.unionByName(known).groupBy("site").agg(F.min_by(F.struct("url", "alt"), F.struct("step", "ord")).alias("l"))
    return best.select("site", "l.*")


def hero_pick(images: DataFrame, heads: DataFrame) -> DataFrame:
    """(site, url, alt): the first image with the role, else the home page's og:image, else the first wide image, else the first that is no logo or icon.

    images: site_images(); heads(site, image): the og:image of home pages, empty or null for none.
    """
    usable = ~F.col("role").isin("logo", "icon")
    step = F.when(F.col("role") == "hero", 0).when(usable & (F.col("width") >= 600), 2).when(usable, 3)
    own = images.select("site", step.alias("step"), "ord", "url", "alt").where("step is not null")
    shared = heads.where("image <> ''").select("site", F.col("image").alias("url")).join(images.select("site", "url", "alt"), ["site", "url"], "left").select("site", F.lit(1).alias("step"), F.lit(0).alias("ord"), "url", F.coalesce("alt", F.lit("")).alias("alt"))
    return own.unionByName(shared).groupBy("site").agg(F.min_by(F.struct("url", "alt"), F.struct("step", "ord")).alias("h")).select("site", "h.*")


def gallery_pick(images: DataFrame, logos: DataFrame, heroes: DataFrame, most: int = GALLERY_MOST) -> DataFrame:
    """(site, ord, src, alt, caption, category): images but logo, hero, icons and backgrounds, of unknown width or at least 300 wide."""
    taken = logos.select("site", "url").unionByName(heroes.select("site", "url"))
    rows = images.join(taken, ["site", "url"], "left_anti").where(~F.col("role").isin("logo", "icon", "background") & F.coalesce(F.col("width") >= 300, F.lit(True)))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("ord"))).where(F.col("nth") <= most)
    return ranked.select("site", F.col("nth").alias("ord"), F.col("url").alias("src"), "alt", F.col("title").alias("caption"), F.when(F.col("role") == "team", "team").otherwise("").alias("category"))


def asset_list(images: DataFrame, logos: DataFrame, heroes: DataFrame, gallery: DataFrame, most: int = ASSETS_MOST) -> DataFrame:
    """(site, ord, role, url, alt, file): logo, hero, gallery and team images, the first of each address, with numbered file names."""
    parts = (
        (logos.withColumn("ord", F.lit(0)), "logo", "url"), (heroes.withColumn("ord", F.lit(0)), "hero", "url"), (gallery, "gallery", "src"), (images.where("role = 'team'"), "team", "url"),
    )
    rows = None
    for i, (df, name, column) in enumerate(parts):
        one = df.select("site", F.struct(F.lit(i).alias("part"), "ord").alias("at"), F.lit(name).alias("role"), F.col(column).alias("url"), "alt")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy("site", "url").agg(F.min("at").alias("at"), F.min_by(F.struct("role", "alt"), "at").alias("f"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("at"))).where(F.col("ord") <= most)
    number = F.lpad(F.col("ord").cast("string"), 2, "0")
    name = F.regexp_replace(U.basename(F.col("url")), r"(?i)\.[a-z0-9]+$", "")
    plain = T.slug(name, "")
    stem = F.when(plain != "", plain).otherwise(F.concat_ws("-", "f.role", F.col("ord").cast("string")))
    end = F.when(U.extension(F.col("url")) == "", ".jpg").otherwise(U.extension(F.col("url")))
    return ranked.select("site", "ord", "f.role", "url", "f.alt", F.concat(F.col("f.role"), F.lit("-"), number, F.lit("-"), stem, end).alias("file"))
