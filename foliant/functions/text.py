"""Text expressions: fonts, token estimates, numbering, captions, headings, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it: keeps plans small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


# ------------------------------------------------------------------ fonts


def is_bold_font(name: Column) -> Column:
    return F.lower(name).rlike("bold|-bd|heavy|black")


def is_italic_font(name: Column) -> Column:
    return F.lower(name).rlike("italic|oblique|-it")


def is_math_font(name: Column, extra: tuple[str, ...] = ()) -> Column:
    upper = F.upper(name)
    out = upper.rlike("^CM[A-Z]|MATH|SYMBOL|^MT|STIX")
    for x in extra:
        out = out | upper.contains(x.upper())
    return out


# ------------------------------------------------------------------ tokens

CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}]"


def count_chars(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def tokens(text: Column) -> Column:
    """Heuristic tokens: a quarter of ASCII, each CJK letter, half of the rest."""
    ascii_, cjk = count_chars(text, r"[\x00-\x7F]"), count_chars(text, CJK)
    counts = F.struct(ascii_.alias("a"), cjk.alias("c"), F.length(text).alias("n"))
    return let(counts, lambda x: (F.floor(x.a / 4) + x.c + F.floor((x.n - x.a - x.c) / 2)).cast("long"))


def toc_tokens(text: Column) -> Column:
    ascii_ = count_chars(text, r"[\x00-\x7F]")
    return (F.floor(ascii_ / 4) + F.floor((F.length(text) - ascii_) / 1.5)).cast("long")


def py_tokens(text: str) -> int:
    """``tokens`` in Python, for folds."""
    if text.isascii():
        return len(text) // 4
    a = c = 0
    for ch in text:
        o = ord(ch)
        if o < 128:
            a += 1
        elif 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF or 0xFF00 <= o <= 0xFFEF:
            c += 1
    return a // 4 + c + (len(text) - a - c) // 2


# ------------------------------------------------------------------ numbering

# The four forms of section numbers.
APPENDIX = r"(?U)^Appendix\s+([A-Z])\b\.?"
ARABIC = r"(?U)^(\d+(?:\.\d+)*)\.?(?:\s+|$)"
ROMAN = r"(?U)^([IVXLCDM]+)\.(?:\s+|$)"
ALPHA = r"(?U)^([A-Z])\.(?:\s+|$)"
MOST = 4294967295


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def roman_value(numeral: Column) -> Column:
    """Subtractive from the right, without a check of form; null for none or a zero."""
    letters = F.transform(F.reverse(F.split(numeral, "")), lambda c: F.coalesce(F.try_element_at(F.expr(ROMAN_DIGITS), c), F.lit(0)))
    state = F.aggregate(
        letters,
        F.struct(F.lit(0).alias("t"), F.lit(0).alias("p")),
        lambda s, v: F.when(v < s.p, F.struct((s.t - v).alias("t"), s.p.alias("p"))).otherwise(F.struct((s.t + v).alias("t"), v.alias("p"))),
    )
    value = state.t
    return F.when(numeral.rlike("^[IVXLCDM]+$") & (value > 0), value)


ROMAN_DIGITS = "map('I', 1, 'V', 5, 'X', 10, 'L', 50, 'C', 100, 'D', 500, 'M', 1000)"


def numbering(text: Column) -> Column:
    return let(F.regexp_replace(text, r"(?U)^\s+", ""), _numbering)


def _numbering(text: Column) -> Column:
    """Struct (components array<struct<variant, ord>>, is_appendix, depth, prefix, rest) of the
    number that a header begins with; null if there is none.  Variants: 0 Arabic, 1 Roman, 2 letter.
    Arabic parts count for the depth whatever their size; components hold those up to MOST."""
    one = lambda v, o: F.array(F.struct(F.lit(v).alias("variant"), o.cast("long").alias("ord")))
    digits = lambda x: F.filter(F.split(x, r"\."), lambda y: y.rlike("^[0-9]+$"))
    numbers = lambda x: F.filter(F.transform(digits(x), lambda y: y.try_cast("decimal(38,0)")), lambda y: y <= MOST)
    # the first form that matches: which, its number, and all that it takes up
    forms = F.array(*[F.struct(F.lit(k).alias("k"), _part(text, p).alias("n"), _part(text, p, 0).alias("whole")) for k, p in enumerate((APPENDIX, ARABIC, ROMAN, ALPHA))])

    def components(f: Column) -> Column:
        arabic = F.transform(numbers(f.n), lambda x: F.struct(F.lit(0).alias("variant"), x.cast("long").alias("ord")))
        return F.when(f.k == 1, arabic).when(f.k == 2, let(roman_value(f.n), lambda v: one(1, v))).otherwise(one(2, F.ascii(f.n) - 64))

    def key(f: Column) -> Column:
        return let(
            components(f),
            lambda c: F.struct(
                c.alias("components"), (f.k == 0).alias("is_appendix"), F.when(f.k == 1, F.size(digits(f.n))).otherwise(1).alias("depth"), trim(f.whole).alias("prefix"), trim(F.substring(text, F.length(f.whole) + 1, F.length(text))).alias("rest")
            ),
        )

    good = F.filter(forms, lambda f: (f.n != "") & ((f.k != 1) | (F.size(digits(f.n)) > 0)) & ((f.k != 2) | roman_value(f.n).isNotNull()))
    return F.get(F.transform(F.slice(good, F.lit(1), F.lit(1)), key), F.lit(0))


# ------------------------------------------------------------------ captions

FIGURE_CAPTION = r"(?iU)^(Fig\.?|Figure)\s*(\d+)\s*[:.]?\s*(.*)"
TABLE_CAPTION = r"(?iU)^(Table|Tab\.)\s*(\d+)\s*[:.]?\s*(.*)"


def caption(text: Column) -> Column:
    """Struct (caption_type, prefix, number, description, full_text), or null."""
    def parts(t, kind, pattern):
        number = let(F.try_to_number(_part(t, pattern, 2), F.lit("9" * 12)).cast("long"), lambda n: F.when(n <= MOST, n))
        return F.struct(F.lit(kind).alias("caption_type"), _part(t, pattern, 1).alias("prefix"), number.alias("number"), trim(_part(t, pattern, 3)).alias("description"), t.alias("full_text"))

    return let(trim(text), lambda t: F.when(t.rlike(FIGURE_CAPTION), parts(t, "Figure", FIGURE_CAPTION)).when(t.rlike(TABLE_CAPTION), parts(t, "Table", TABLE_CAPTION)))


def is_caption(text: Column, max_chars: int = 240) -> Column:
    """The classifier's stricter rule: a number and a delimiter must follow."""
    t = trim(text)
    return (F.length(t) <= max_chars) & F.lower(t).rlike(r"(?U)^(figure|fig\.|table|tab\.)\s*[0-9]+\s*[:.]")


def caption_description(text: Column) -> Column:
    """What follows the first colon; else the first full stop, with a number after it skipped."""
    t = trim(text)
    dot = trim(F.substring(t, F.locate(".", t) + 1, F.length(t)))
    return (
        F.when(t.contains(":"), trim(F.substring(t, F.locate(":", t) + 1, F.length(t))))
        .when(~t.contains("."), t)
        .when(dot.rlike("^[0-9]"), F.when(dot.contains(" "), trim(F.substring(dot, F.locate(" ", dot), F.length(dot)))).otherwise(t))
        .otherwise(dot)
    )


# ------------------------------------------------------------------ headings


def is_page_number(text: Column) -> Column:
    t = trim(text)
    return t.rlike(r"^[0-9 ]*[0-9][0-9 ]*$") & (F.octet_length(t) <= 4)


def is_all_caps(text: Column) -> Column:
    """Every letter is upper case, and there is one."""
    return text.rlike(r"\p{IsAlphabetic}") & ~text.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")


def fold_upper(text: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.upper(F.translate(trim(text), wide, "".join(chr(ord(c) - 0xFEE0) for c in wide)))


def is_known_name(text: Column, names: tuple[str, ...], margin: int = 8) -> Column:
    """Equal to a section name, or not much longer and containing one."""
    known = F.lit(list(names))
    return let(fold_upper(text), lambda norm: F.exists(known, lambda n: (F.length(norm) <= F.length(n) + margin) & F.contains(norm, n)))


HEADING_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7A3}]"


def is_cjk_heading(text: Column, max_chars: int = 120) -> Column:
    t = trim(text)
    solid = F.regexp_replace(t, WS, "")
    share = F.when(F.length(solid) > 0, count_chars(solid, HEADING_CJK) / F.length(solid)).otherwise(0.0)
    return (share > 0.5) & (F.length(t) <= max_chars) & ~t.rlike(r"[。．.]$")


# ------------------------------------------------------------------ metadata and escapes


def split_authors(raw: Column) -> Column:
    names = F.split(F.regexp_replace(raw, r"(?iU)\band\b", ","), r"[,\n]")
    return F.filter(F.transform(names, trim), lambda s: F.octet_length(s) > 1)


DOI = r"10\.\p{Nd}{4,9}/[-._;()/:A-Za-z0-9]+"


def doi(text: Column) -> Column:
    """First identifier after white space is collapsed, without full stops at its end; or null."""
    found = F.regexp_extract(trim(F.regexp_replace(text, r"(?U)\s+", " ")), DOI, 0)
    return F.when(found != "", F.regexp_replace(found, r"\.+$", ""))


def sentences(text: Column) -> Column:
    """Lossless: cuts after . ! ? before white space, and after full-width stops."""
    return F.filter(F.split(text, r"(?U)(?<=[。！？])|(?<=[.!?])(?=\s)", -1), lambda s: s != "")


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("]("), F.lit("]\\("))


def escape_pipe(text: Column) -> Column:
    return F.replace(F.replace(escape_markdown(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def escape_csv(text: Column) -> Column:
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def escape_yaml(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def equation_number(text: Column) -> Column:
    """``(n)`` at the end: letters, digits and full stops, at most ten bytes; or null."""
    inside = F.regexp_extract(trim(text), r"\(([^(]*)\)$", 1)
    return F.when(inside.rlike(r"^[\p{IsAlphabetic}\p{N}.]+$") & (F.octet_length(inside) <= 10), F.concat(F.lit("("), inside, F.lit(")")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
