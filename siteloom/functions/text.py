"""Text expressions. Empty strings stand for absent text, as in profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.once import let

#: White space as browsers see it, with the no-break space; read alike by Java's and RE2's regular expressions.
SPACE_CLASS = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Latin letters with marks and their bare forms, place by place.
MARKED = "àáâãäåāăąçćčďèéêëēęěìíîïīñńňòóôõöōőŕřśšťùúûüūůűýÿźžżÀÁÂÃÄÅÇČÈÉÊËÌÍÎÏÑÒÓÔÕÖŘŠÙÚÛÜÝŽ"
BARE = "aaaaaaaaacccdeeeeeeeiiiiinnnooooooorrsstuuuuuuuyyzzzAAAAAACCEEEEIIIINOOOOORSUUUUYZ"
#: Words that keep their own case in titles, and words that stay small there.
ACRONYMS = (
    "HVAC AC A/C LLC PLLC LLP USA UK NY TX FL BBB ASE EPA OSHA NATE ADA FAQ DIY VIP CEO CFO COO CPA MBA DDS DMD DVM MD RN LPN PT OT LMT PhD ND DC "
    "TV PC SEO PPC CRM POS GPS RV ATV UTV SUV CDL DOT MPG MPH PSI BTU SEER HP PVC HDPE LED UV HEPA GFCI AFCI MERV CFM IAQ R22 R410A 24/7 3D 2D HD 4K QR PDF FAQS"
).split()
SMALL_WORDS = "a an and as at but by for in nor of on or the to up via with".split()


def squash(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE_CLASS + "+", " "))


def ascii_words(pattern: str) -> str:
    r"""A pattern whose \b knows ASCII's word characters only, as browsers and RE2 have it; Java's takes other letters for word characters, too."""
    return pattern.replace(r"\b", r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")


def _capital(c: Column) -> Column:
    """A text with its first letter as a capital, where that is one letter."""
    return let(F.upper(F.substring(c, 1, 1)), lambda first: F.when(F.length(first) == 1, F.concat(first, F.substring(c, 2, 1 << 20))).otherwise(c))


def filled(c: Column) -> Column:
    """The text if it isn't blank, else null."""
    return F.when(squash(c) != "", c)


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[^{SPACE_CLASS[1:-1]}]+")).cast("bigint")


def slug(c: Column, fallback: str = "item") -> Column:
    """Lower-case letters and digits joined by hyphens, 60 characters at most."""
    plain = F.replace(F.lower(F.translate(F.coalesce(c, F.lit("")), MARKED, BARE)), F.lit("&"), F.lit(" and "))
    short = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    done = F.regexp_replace(short, "-+$", "")
    return F.regexp_replace(done, "^$", fallback) if fallback else done


def truncate_words(c: Column, most: int = 160, suffix: str = "…") -> Column:
    """The text, or its start up to a blank in the last two fifths, without trailing punctuation, and the suffix."""
    def short(s: Column) -> Column:
        cut = F.substring(s, 1, most - len(suffix))
        start = let(F.regexp_extract(cut, r"^([\s\S]*) ", 1), lambda stem: F.when(F.length(stem) > most * 0.6, stem).otherwise(cut))
        return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(start, r"[,;:.\-\s]+$", ""), F.lit(suffix)))

    return let(squash(c), short)


def _acronym(word: Column) -> Column:
    """The word in its own case, or null if it isn't a known one. The map is written as one text, which is folded once."""
    known = F.str_to_map(F.lit(",".join(f"{a.lower()}:{a}" for a in ACRONYMS)), F.lit(","), F.lit(":"))
    return F.try_element_at(known, F.lower(word))


def _name_part(part: Column) -> Column:
    irish, mac = r"^([OD])(['\x{2019}])([a-z])(.*)$", r"^(Ma?c)([a-z])(.{2,})$"

    def cased(base: Column) -> Column:
        join = lambda p, at: F.concat(*[F.upper(F.regexp_extract(base, p, i)) if i == at else F.regexp_extract(base, p, i) for i in range(1, at + 2)])
        return F.when(base.rlike(irish), join(irish, 3)).when(base.rlike(mac), join(mac, 2)).otherwise(base)

    return let(_capital(part), cased)


def _cased(word: Column) -> Column:
    shape = r"(?i)^([^a-z0-9]*)([a-z0-9/&.\x{2019}'-]*)([^a-z0-9]*)$"

    def whole(core: Column) -> Column:
        parts = F.array_join(F.transform(F.split(core, "-"), lambda p: F.coalesce(_acronym(p), _name_part(p))), "-")
        joined = F.concat(F.regexp_extract(word, shape, 1), F.coalesce(_acronym(core), parts), F.regexp_extract(word, shape, 3))
        return F.when(core == "", word).otherwise(joined)  # a word of another shape has no core

    return let(F.regexp_extract(word, shape, 2), whole)


def title_case(c: Column) -> Column:
    def cased(words: Column) -> Column:
        inner = lambda i: (i > 0) & (i < F.size(words) - 1)
        return F.array_join(F.transform(words, lambda w, i: F.when(inner(i) & w.isin(SMALL_WORDS), w).otherwise(_cased(w))), " ")

    return let(F.split(F.lower(squash(c)), " "), cased)


def humanize_heading(c: Column) -> Column:
    """Shouted headings in title case, headings without capitals with a capital and known acronyms."""
    shape = r"(?i)^([^a-z0-9]*)([a-z0-9/&]+)(.*)$"
    restored = lambda w: F.coalesce(F.concat(F.regexp_extract(w, shape, 1), _acronym(F.regexp_extract(w, shape, 2)), F.regexp_extract(w, shape, 3)), w)

    def humanized(x: Column) -> Column:
        s, letters, capitals = x["s"], x["letters"], F.length(F.regexp_replace(x["s"], "[^A-Z]", ""))
        low = let(F.array_join(F.transform(F.split(s, " "), restored), " "), _capital)
        return F.when((letters > 3) & (capitals > 0.8 * letters), title_case(s)).when((letters > 0) & (capitals == 0), low).otherwise(s)

    return let(squash(c), lambda s: let(F.struct(s.alias("s"), F.length(F.regexp_replace(s, "[^a-zA-Z]", "")).alias("letters")), humanized))


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(plural or f"{singular}s"))


def format_bytes(n: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    return F.when(n < kb, F.format_string("%d B", n.cast("bigint"))).when(n < mb, F.format_string("%.1f KB", n / kb)).otherwise(F.format_string("%.2f MB", n / mb))
