"""Column expressions over document text: cleaning, identifiers, windows, names and ids.

Everything here is a Column -> Column function built from Spark SQL functions,
so it stays inside the JVM and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
# Layout attributes removed from leftover table markup.
TABLE_ATTRIBUTES = (
    "rowspan|colspan|style|class|width|height|align|valign|border|cellpadding|cellspacing"
)

# Headings of figure directories and closing sections, searched in this order.
SECTION_HEADINGS = [
    r"#\s*图目录",
    r"#\s*图表目录",
    r"#\s*插图目录",
    r"#\s*图形目录",
    r"#\s*图片目录",
    r"#\s*图索引",
    r"#\s*图表索引",
    r"#\s*插图索引",
    r"#\s*图形索引",
    r"#\s*图\s*目\s*录",
    r"#\s*图\s*索\s*引",
    r"#\s*目录\s*图",
    r"#\s*索引\s*图",
    r"#\s*图\s*表\s*目\s*录",
    r"#\s*插\s*图\s*目\s*录",
    r"#\s*Figure\s*Directory",
    r"#\s*Table\s*of\s*Figures",
    r"#\s*Figures\s*List",
    r"#\s*List(\s*of)?\s*Figures",
    r"#\s*Index\s*of\s*Figures",
    r"#\s*Figure\s*Index",
    r"#\s*Contents\s*of\s*Figures",
    r"#\s*Figures\s*Contents",
    r"#\s*Figure\s*Catalog",
    r"#\s*Catalog\s*of\s*Figures",
    r"#\s*List\s*of\s*Illustrations",
    r"#\s*Illustrations\s*List",
    r"#\s*Index\s*of\s*Illustrations",
    r"#\s*Illustrations\s*Index",
    r"#\s*Table\s*of\s*Illustrations",
    r"#\s*Illustrations\s*Directory",
    r"#\s*Illustrations\s*Catalog",
    r"#\s*Catalog\s*of\s*Illustrations",
    r"#\s*List\s*of\s*Tables\s*and\s*Figures",
    r"#\s*Tables\s*and\s*Figures\s*List",
    r"#\s*Index\s*of\s*Tables\s*and\s*Figures",
    r"#\s*Table\s*of\s*Contents\s*Figures",
    r"#\s*List\s*of\s*Figures\s*and\s*Tables",
    r"#\s*Figures\s*and\s*Tables\s*List",
    r"#\s*List\s*of\s*Charts",
    r"#\s*Charts\s*List",
    r"#\s*Index\s*of\s*Charts",
    r"#\s*Chart\s*Index",
    r"#\s*Table\s*of\s*Charts",
    r"#\s*List\s*of\s*Graphs",
    r"#\s*Graphs\s*List",
    r"#\s*Index\s*of\s*Graphs",
    r"#\s*Graph\s*Index",
    r"#\s*Table\s*of\s*Graphs",
    r"#\s*List\s*of\s*Contents",
    r"#\s*Contents\s*List",
    r"#\s*Index\s*of\s*Contents",
    r"#\s*\d+\s*LESSONS\s*AND\s*RECOMMENDATIONS",
    r"#\s*LESSONS\s*AND\s*RECOMMENDATIONS",
    r"#\s*\d+\s*CONCLUSIONS",
    r"#\s*CONCLUSIONS",
    r"#\s*\d+\s*SUMMARY",
    r"#\s*SUMMARY",
    r"#\s*\d+\s*RESULTS?\s*AND\s*DISCUSSION",
    r"#\s*RESULTS?\s*AND\s*DISCUSSION",
    r"#\s*\d+\s*FINDINGS",
    r"#\s*FINDINGS",
    r"#\s*\d+\s*ANALYSIS",
    r"#\s*ANALYSIS",
    r"#\s*\d+\s*RESULTS?",
    r"#\s*RESULTS?",
]

IMAGE_TAG = r"!\[.*?\]\(\.\./images/[^/]+/([^)]+)\)"
RAW_IMAGE_TAG = r"!\[\]\((images/[^)]+)\)"
CAPTION = r"(?iU)(?:图\s*[a-zA-Z]?\d|Fig(?:ure|\.?)\s*\d)"
FIGURE_START = r"(?iU)^\s*(?:图|fig)"
# A figure label: 图 with an optional letter, Figure or Fig., then dotted or dashed numbers.
FIGURE_LABEL = r"(?iU)(图\s*[a-zA-Z]?\s*\d+(?:[.-]\d+)*|Figure\s*\d+(?:[.-]\d+)*|Fig\.?\s*\d+(?:[.-]\d+)*)"
SENTENCE_ENDS = ".?!。？！"
CJK = "[一-鿿]"
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# ----------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


def lstrip(col) -> Column:
    return F.ltrim(_c(col), F.lit(WHITE_SPACE))


def is_blank(char: Column) -> Column:
    """Whether a single character is white space of any kind."""
    return char.isin(*WHITE_SPACE)


def strip_ends(col) -> Column:
    """As :func:`strip`, whose search from the end lists the whole text, so only where there is something to remove."""
    c = _c(col)
    return F.when(is_blank(F.left(c, F.lit(1))) | is_blank(F.right(c, F.lit(1))), strip(c)).otherwise(c)


def newline_count(col) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def clean_html_tables(col) -> Column:
    """Turn table cells into lines, drop table markup and layout attributes, normalise blanks."""
    c = F.regexp_replace(_c(col), r"(?i)<(t[dh])(?=[0-9. ])", "<$1>")
    c = F.regexp_replace(c, r"(?i)</?(?:td|th)[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(?:table|tr|tbody|thead|tfoot)[^>]*>", "")

    def plain(t):
        for quote in ('"', "'"):
            t = F.regexp_replace(t, rf"(?i)\s*(?:{TABLE_ATTRIBUTES})\s*=\s*{quote}[^{quote}]*{quote}", "")
        return t

    # the names are tried at every place of a text, so only where a value in quotes is in it
    c = bind(c, lambda t: F.when(t.rlike("=\\s*[\"']"), plain(t)).otherwise(t))
    # runs of blanks, without the single ones, which stay what they are
    c = F.regexp_replace(c, r"\t[ \t]*| [ \t]+", " ")
    c = F.regexp_replace(c, r"(?U)\n\s*\n", "\n\n")
    return strip(c)


def drop_section(col, headings: list[str] | None = None) -> Column:
    """Delete the section under the first heading found, trying headings in list order."""
    c = _c(col)
    headings = SECTION_HEADINGS if headings is None else headings
    starts = [F.nullif(F.regexp_instr(c, F.lit(f"(?iU){h}")), F.lit(0)) for h in headings]

    def cut(start):
        stop = F.call_function("locate", F.lit("\n#"), c, start + 1)
        head = F.left(c, start - 1)
        return strip(F.when(stop > 0, F.concat(head, F.substr(c, stop))).otherwise(head))

    # The lambda binds the position once; texts without any heading never search for it.
    return F.when(c.rlike(any_heading(headings)), F.transform(F.array(F.coalesce(*starts)), cut)[0]).otherwise(c)


def any_heading(headings: list[str]) -> str:
    """One pattern for all headings; the mark that they all start with is looked for once, not once a heading."""
    mark = r"#\s*"
    if headings and all(h.startswith(mark) and h[len(mark) :][:1] not in ("+", "?") and "|" not in h for h in headings):
        return f"(?iU){mark}(?:" + "|".join(h[len(mark) :] for h in headings) + ")"
    return "(?iU)" + "|".join(f"(?:{h})" for h in headings)


def fix_ocr_digits(col) -> Column:
    """Letters o/O read for a zero behind a figure number, and 一 read for a dash between digits."""
    c = _c(col)
    for letter in ("o", "O"):
        c = F.regexp_replace(c, rf"([Ff]ig(?:ure|\.?)\s*\d+){letter}", "$10")
        c = F.regexp_replace(c, r"(图\s*\d+)[oO]" if letter == "o" else r"(图\s*\d+)O", "$10")
    c = F.regexp_replace(c, r"(?<=\d)一(?=\d)", "-")
    return F.regexp_replace(c, r"(?i)(f(?:igure|ig\.?)|图)\s*(\d+)o", "$1$20")


def clean_document(col, only_with_section: bool = False) -> Column:
    """Drop the figure directory, clean table markup, repair digits."""
    c = _c(col)
    cleaned = fix_ocr_digits(clean_html_tables(drop_section(c)))
    if not only_with_section:
        return cleaned
    return F.when(c.rlike(any_heading(SECTION_HEADINGS)), cleaned).otherwise(c)


def figure_identifier(col) -> Column:
    """First figure label of a text, NULL when there is none."""
    return F.nullif(F.regexp_extract(_c(col), FIGURE_LABEL, 1), F.lit(""))


def figure_labels(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(FIGURE_LABEL), F.lit(1))


def placed_labels(col) -> Column:
    """Every figure label of a text with the number of characters in front of it: array of struct(label, at)."""

    def place(x):
        def at(label, i):
            gaps = F.aggregate(F.slice(x["gaps"], F.lit(1), i + 1), F.lit(0), lambda n, g: n + F.length(g))
            return gaps + F.aggregate(F.slice(x["labels"], F.lit(1), i), F.lit(0), lambda n, g: n + F.length(g))

        return F.transform(x["labels"], lambda label, i: F.struct(label.alias("label"), at(label, i).alias("at")))

    def found(labels):
        # a single label stands where it is first found; nothing in front of it can be read as one
        one = F.transform(labels, lambda label: F.struct(label.alias("label"), (F.instr(_c(col), label) - 1).alias("at")))
        return F.when(F.size(labels) == 1, one).otherwise(bind(F.struct(labels.alias("labels"), F.split(_c(col), FIGURE_LABEL).alias("gaps")), place))

    return bind(figure_labels(col), found)


def matches_caption(col) -> Column:
    return _c(col).rlike(CAPTION)


def is_caption(line, paragraph_first_line) -> Column:
    """A caption names a figure and it, or its paragraph, starts with a figure word."""
    return matches_caption(line) & starts_figure(line, paragraph_first_line)


def starts_figure(line, paragraph_first_line) -> Column:
    return _c(line).rlike(FIGURE_START) | F.coalesce(_c(paragraph_first_line).rlike(FIGURE_START), F.lit(False))


def has_digit_run(col, n: int = 3) -> Column:
    return _c(col).rlike(rf"\d{{{n}}}")


def char_window(text, start, n: int = 2000) -> Column:
    """Up to n characters on either side of 1-based position ``start``."""
    t, s = _c(text), _c(start)
    lo = F.greatest(F.lit(1), s - n)
    return F.substr(t, lo, s + n - lo)


def chunks(text, n: int = 10000) -> Column:
    """Array of consecutive pieces of n characters."""
    t = _c(text)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(n)), lambda i: F.substr(t, i + 1, F.lit(n)))
    )


def head_tail(text, n: int = 2000) -> Column:
    return F.concat(F.left(_c(text), F.lit(n)), F.right(_c(text), F.lit(n)))


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; an expression used twice is computed twice."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column, block: int = 64) -> Column:
    """Sum of the values in front of each element of a non-empty integer array.

    Appending to an array copies it, so sums are built in short blocks that start from
    the sum of the blocks before them; a long document costs little more than its length.
    """
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        return F.struct((acc["total"] + x).alias("total"), F.array_append(acc["out"], acc["total"]).alias("out"))

    def within(blocks):
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x))
        return bind(
            F.aggregate(sums, start, step, lambda acc: acc["out"]),
            lambda before: F.flatten(
                F.transform(
                    blocks,
                    lambda b, k: F.aggregate(
                        b,
                        F.struct(F.get(before, k).alias("total"), F.array().cast("array<int>").alias("out")),
                        step,
                        lambda acc: acc["out"],
                    ),
                )
            ),
        )

    def cut(v):
        last = F.floor((F.size(v) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * block + 1, F.lit(block)))

    return bind(bind(values, cut), within)


def _cjk_count(t: Column) -> Column:
    return F.length(t) - F.length(F.regexp_replace(t, f"{CJK}+", ""))


def _share(t: Column) -> Column:
    return F.coalesce(_cjk_count(t) / F.nullif(F.length(t), F.lit(0)), F.lit(0.0))


def cjk_share(col) -> Column:
    return bind(F.regexp_replace(_c(col), r"\s+", ""), _share)


def is_chinese(col, share: float = 0.3) -> Column:
    """Share of CJK characters; very short texts need more than half."""

    def judge(t, bare):
        squeezed = strip(F.regexp_replace(t, r"\s+", " "))
        short = bind(squeezed, lambda q: F.when(F.length(q) < 3, _share(q) > 0.5))
        # three characters besides blanks are three with them, too
        return F.coalesce(F.when(F.length(bare) < 3, short), _share(bare) >= share)

    return bind(_c(col), lambda t: bind(strip(F.regexp_replace(t, r"\s+", "")), lambda bare: judge(t, bare)))


SNAP = 200  # borders move by fewer characters than this


def _last_end_before(text: Column, stop: Column) -> Column:
    """0-based position of the last sentence end before 0-based ``stop`` and close enough to snap to, -1 if none."""
    first = F.greatest(stop - (SNAP - 1), F.lit(0))

    def find(near):
        at = F.regexp_instr(F.reverse(near), F.lit(f"[{SENTENCE_ENDS}]"))
        return F.when(at > 0, first + F.length(near) - at).otherwise(F.lit(-1))

    return bind(F.substr(text, first + 1, stop - first), find)


def _first_end_from(text: Column, start: Column) -> Column:
    """0-based position of the first sentence end at or after 0-based ``start`` and close enough to snap to, NULL if none."""
    at = F.regexp_instr(F.substr(text, start + 1, F.lit(SNAP)), F.lit(f"[{SENTENCE_ENDS}]"))
    return F.when(at > 0, start + at - 1)


def _snap(text: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Move both borders outward to a sentence end closer than 200 characters."""
    before = _last_end_before(text, lo)
    after = _first_end_from(text, hi)
    return (
        F.when((before >= 0) & (lo - before < 200), before + 1).otherwise(lo),
        F.when(after - hi < 200, after + 1).otherwise(hi),
    )


def trim_to_sentences(text, max_chars: int | Column = 1000) -> Column:
    """Middle part of a long text, widened to whole sentences.

    The window of max+400 characters is snapped outward; when it is still too
    long it is centred on the sentence end nearest the middle (first kept of
    each kind of sentence end, earlier kinds win ties) and snapped again.
    """
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    marks = F.array(*[F.lit(e) for e in SENTENCE_ENDS])

    def sized(given):
        # the limit may be a costly expression
        return F.struct(
            _c(text).alias("t"),
            F.length(_c(text)).alias("n"),
            given.alias("max"),
            F.floor(F.length(_c(text)) / 2).cast("int").alias("mid"),
            F.floor(given / 2).cast("int").alias("half"),
        )

    def cut(x):
        t, n, mid, half = x["t"], x["n"], x["mid"], x["half"]

        def widen(lo, hi):
            return bind(F.struct(lo.alias("lo"), hi.alias("hi")), lambda s: F.struct(*[
                c.alias(k) for k, c in zip(("lo", "hi"), _snap(t, s["lo"], s["hi"]))
            ]))

        def anchor():
            """First position of each kind of sentence end within 100 characters of the middle."""
            base = F.greatest(F.lit(0), mid - 100)
            near = F.substr(t, base + 1, mid + 100 - base)
            found = bind(near, lambda s: F.filter(F.transform(marks, lambda e: F.instr(s, e)), lambda p: p > 0))
            return F.aggregate(
                F.transform(found, lambda p: base + p - 1),
                F.lit(-1),
                lambda best, p: F.when((best == -1) | (F.abs(p - mid) < F.abs(best - mid)), p).otherwise(best),
            )

        def finish(span):
            recentred = bind(
                anchor(),
                lambda m: F.when(m >= 0, widen(F.greatest(F.lit(0), m - half), F.least(n, m + half))).otherwise(span),
            )
            return F.when(span["hi"] - span["lo"] > x["max"], recentred).otherwise(span)

        first = widen(F.greatest(F.lit(0), mid - half - 200), F.least(n, mid + half + 200))
        return F.when(n <= x["max"], t).otherwise(
            bind(bind(first, finish), lambda s: strip(F.substr(t, s["lo"] + 1, s["hi"] - s["lo"])))
        )

    return bind(bind(limit, sized), cut)


def expand_abbreviations(text, table, word_boundary: bool = True, first_only: bool = False) -> Column:
    """Write ``ABBR (Full Form)`` for every run of capitals found in the map column, in one pass.

    The text is cut at the borders of word runs, so each piece is either a word or the
    text between words and the join of the pieces is the text again.
    """
    t, m = _c(text), _c(table)
    piece = r"(?U)\w+|\W+" if word_boundary else r"(?s)[A-Z]{2,}|(?:(?![A-Z]{2}).)+"
    pieces = F.regexp_extract_all(t, F.lit(f"({piece})"), F.lit(1))

    def one(p, i):
        full = F.try_element_at(m, p)
        hit = p.rlike("^[A-Z]{2,}$") & full.isNotNull()
        if first_only:
            hit = hit & (F.array_position(pieces, p) == i + 1)
        return F.when(hit, F.concat(p, F.lit(" ("), full, F.lit(")"))).otherwise(p)

    expanded = F.array_join(F.transform(pieces, one), "")
    return F.when(m.isNull() | (F.size(m) == 0) | (t == ""), t).otherwise(expanded)


def insert_block(context, expansions) -> Column:
    """Put the list of expansions behind the sentence that names the image path, else at the end."""
    c, m = _c(context), _c(expansions)
    rows = F.transform(
        F.map_entries(m), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"], F.lit("\n"))
    )
    # fixed values: the sentences a summary reader looks for
    block = F.when(
        F.coalesce(F.size(m), F.lit(0)) > 0,
        F.concat(F.lit("\nAcronyms found in the image and their expansions:\n"), F.array_join(rows, "")),
    ).otherwise(F.lit("\n\nNo acronyms were found in the image."))
    marker = F.locate("The path of this image is:", c)
    end = F.call_function("locate", F.lit(".\n\n"), c, F.greatest(marker, F.lit(1)))
    return F.when(
        (marker > 0) & (end > 0), F.concat(F.left(c, end + 1), block, F.substr(c, end + 2))
    ).otherwise(F.concat(c, block))


# ---- names, ids, numbers -----------------------------------------------------------


def sanitize_name(col, rule: str) -> Column:
    """File-name rules: ``drop`` reserved characters, ``word`` keeps letters and digits,
    ``folder`` replaces reserved characters and cuts at 100."""
    c = _c(col)
    if rule == "drop":
        return F.regexp_replace(c, r'[\\/*?:"<>|]', "")
    if rule == "word":
        return strip(F.regexp_replace(c, r"(?U)[^\p{L}\p{N} _-]", "_"))
    if rule == "folder":
        cut = F.left(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), F.lit(100))
        bare = F.regexp_replace(cut, r"^[. ]+|[. ]+$", "")
        return F.when(bare == "", F.lit("unnamed_folder")).otherwise(bare)
    raise ValueError(f"unknown rule {rule!r}")


def extension(col) -> Column:
    """Last dot and what follows, empty for a name without one or with leading dots only."""
    return F.regexp_extract(_c(col), r"(?s)[^.].*?(\.[^.]*)$", 1)


def truncate_name(col, size: int = 100) -> Column:
    """Cut a file name but keep its extension."""
    c = _c(col)
    ext = extension(c)
    room = F.lit(size) - F.length(ext)
    stem = F.left(c, F.length(c) - F.length(ext))
    return (
        F.when(F.length(c) <= size, c)
        .when(room <= 0, F.left(c, F.lit(size)))
        .otherwise(F.concat(F.left(stem, room), ext))
    )


def data_id(name, batch_no) -> Column:
    """Short id of a file in its batch: 16 characters of the stem and the 1-based batch."""
    c = _c(name)
    stem = F.left(c, F.length(c) - F.length(extension(c)))
    return F.concat(F.left(stem, F.lit(16)), F.lit("_b"), (_c(batch_no) + 1).cast("string"))


def zero_fill(col, width: int = 6) -> Column:
    """Pad with zeros on the left; longer values are kept whole."""
    c = _c(col).cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def index_key(book, image) -> Column:
    return F.concat(zero_fill(book), F.lit("-"), zero_fill(image))


def review_path(base: str, book, image, ext: str = ".jpg") -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), zero_fill(book), F.lit("/"), zero_fill(image), F.lit(ext))


def sort_name(level, position, book, image) -> Column:
    return F.format_string("%02d_%04d_%s_%s.jpg", _c(level), _c(position), _c(book), _c(image))


def ids_from_path(path) -> Column:
    """struct(book_id, image_id): the parent folder and the file stem."""
    p = _c(path)
    return F.struct(
        F.regexp_extract(p, r"([^/\\]+)[/\\][^/\\]+$", 1).alias("book_id"),
        F.regexp_extract(p, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1).alias("image_id"),
    )


def context_path(image_path) -> Column:
    """images/<book>/<image>.jpg -> context/<book>/<image>.json"""
    p = F.replace(_c(image_path), F.lit("images/"), F.lit("context/"))
    return F.replace(p, F.lit(".jpg"), F.lit(".json"))


def to_int(col) -> Column:
    """Integer of a string or number, NULL when it is none."""
    return F.regexp_replace(_c(col).cast("string"), r"^\s+|\s+$", "").try_cast("int")


def to_ints(col) -> Column:
    return F.transform(_c(col), lambda x: x.try_cast("int"))


def resolve_url(base, href) -> Column:
    """Absolute URL of a link: kept when absolute, else joined to the base."""
    b, h = _c(base), _c(href)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    host = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*/)", 1)
    folder = F.when(folder.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://$") | (folder == ""), F.concat(host, F.lit("/"))).otherwise(folder)
    path = F.regexp_replace(F.concat(F.substr(folder, F.length(host) + 1), h), r"/(?:\./)+", "/")
    suffix = F.regexp_extract(path, r"([?#].*)$", 1)
    steps = F.split(F.left(path, F.length(path) - F.length(suffix)), "/")
    # dot segments: ".." takes back the step before it
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        ).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    joined = F.concat(host, F.array_join(walked, "/"), suffix)
    return (
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(host, h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
        .when(h.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), h))
        .when(h == "", b)
        .otherwise(joined)
    )
