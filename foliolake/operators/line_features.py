"""Features of lines for classifiers: starts, annotations, lists, paragraphs, kinds.

Lines are rows (doc_id, line_id, text, annotations); every feature is an expression or a
window over the document, and windows share one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .features import doc, order
from .patterns import DOTTED, same_kind_next

#: How numbered lines, items and their kinds begin.
NUMBER = r"(^\s*\d{1,2}(\.\d{1,2})*)(\s|$|\)|\}|\.([A-ZА-Яa-zа-яё]|\s))"
ITEM = r"^\s*\d+\.\s"
YEAR = r"(19\d\d|20\d\d)"
NAMED = r"^(Статья|(Г|г)лава|ГЛАВА|ЧАСТЬ|Часть|Раздел|РАЗДЕЛ|\$|§)\s*((\d+\.*)+|[IVXХxхviУП]{1,3}\.?)\s*"
APPLICATION = r"^(\'|\")?(((П|п)риложение)|((У|у)твержден)[оаы]?){1}(( )*([№nN]?( )*(\d){1,3})?( )*)((к распоряжению)|(к постановлению)|(к приказу))?\s*$"
LAW_ITEMS = (r"^\s*(\d{1,3}\.)+\s*[a-zA-Zа-яА-ЯёЁ]", r"^\s*\d{1,3}(\)|\})")
SUBITEM = r"^\s*[а-яё]\)"
BULLET_PREFIX = r"^\s*(-|—|−|–|®|\.|•|\,|‚|©|⎯|°|\*|>|\| -|●|♣|①|▪|\*|\+)"
LETTER_PREFIX = r"^\s*[а-яёa-z]\)"
BRACKET_PREFIX = r"^\s*\d\)"
NOT_LETTERS = "0123456789{}[]()<>~!@#$%^&*_+-/\"|?.,:;'`= "
NAMED_ITEMS = ("аннотация", "abstract", "введение", "заключение", "библиографическийсписок", "списоклитературы")
NAMED_STARTS = ("приложени", "глава")
THESIS_TITLES = ("бакалаврскаяработа", "магистерскаядиссертация", "выпускнаяквалификационнаяработа", "курсоваяработа", "(подпись)")
TITLE_WORDS = ("автор:", "руководитель:", "научныйруководитель:")
RAW_WORDS = ("рисунок", "таблица")


def start_lengths(text: Column, patterns: tuple[str, ...], suffix: str = "") -> list[Column]:
    """The length of each pattern's match at the start of the stripped text, and how many
    patterns match something."""
    found = [F.length(F.regexp_extract(strip(text), p if p.startswith("^") else f"^(?:{p})", 0)).cast("long") for p in patterns]
    end = f"_{suffix}" if suffix else ""
    total = sum(((f > 0).cast("long") for f in found), F.lit(0).cast("long"))
    return [*(f.alias(f"start_regexp_{i}{end}") for i, f in enumerate(found)), total.alias(f"start_regexp_num_matches{end}")]


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0)).cast("double")


def of_annotations(notes: str = "annotations", text: str = "text") -> list[Column]:
    """What annotations say of a line: size, weight, slope, spacing, indentation, colour."""
    named = lambda name: F.filter(notes, lambda a: a["name"] == name)
    first = lambda name: F.get(named(name), F.lit(0))["value"]
    bold = F.filter(notes, lambda a: (a["name"] == "bold") & (a["value"] == "True"))
    length = F.length(strip(F.col(text)))
    share = F.aggregate(bold, F.lit(0).cast("long"), lambda acc, a: acc + a["end"] - a["start"]) / length
    colour = F.from_json(first("color_annotation"), "red double, green double, blue double")
    rgb = [F.coalesce(colour[c], F.lit(0.0)) for c in ("red", "green", "blue")]
    mean = (rgb[0] + rgb[1] + rgb[2]) / 3
    return [
        F.coalesce(first("size").cast("double"), F.lit(0.0)).alias("font_size"), flag(F.size(bold) > 0).alias("bold"),
        F.when(length == 0, 0.0).otherwise(F.round(F.least(share, F.lit(1.0)), 6)).alias("bold_percent"), flag(F.exists(bold, lambda a: a["start"] == 0)).alias("first_bold"),
        flag(F.size(named("italic")) > 0).alias("italic"), flag(F.size(named("underlined")) > 0).alias("underlined"),
        F.coalesce(first("spacing").cast("double"), F.lit(-1.0)).alias("spacing"), F.coalesce(first("indentation").cast("double"), F.lit(0.0)).alias("indentation"),
        F.round(((rgb[0] - mean) ** 2 + (rgb[1] - mean) ** 2 + (rgb[2] - mean) ** 2) / 2, 6).alias("color_dispersion"),
    ]


def upper_share(text: Column) -> Column:
    """Capitals among the characters that are neither digits, brackets, signs nor blanks."""
    letters = F.regexp_replace(F.translate(text, NOT_LETTERS, ""), r"(?U)\s", "")
    capitals = F.length(F.regexp_replace(letters, r"\P{Lu}", ""))
    return F.round(F.coalesce(F.try_divide(capitals.cast("double"), F.length(letters)), F.lit(0.0)), 6)


def numbers_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\."), lambda x: x != "")


def list_continuity(lines: DataFrame) -> DataFrame:
    """doc_id, line_id, list_item: 1 where a numbered line may follow the numbered line
    before it (1 begins anew, the last part steps by one, or a first part is added), -1
    where not, 0 for other lines. Windows run over the numbered lines alone."""
    number = F.regexp_extract(strip(F.col("text")), NUMBER, 1)
    numbered = lines.select("doc_id", "line_id", number.alias("number")).where("number <> ''").select("doc_id", "line_id", numbers_of(F.col("number")).alias("this"))
    both = numbered.withColumn("that", F.lag("this").over(order()))
    t, p = F.col("this"), F.col("that")
    head = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    step = (F.size(p) == F.size(t)) & (head(t) == head(p)) & (F.element_at(t, -1).try_cast("long") - F.element_at(p, -1).try_cast("long") == 1)
    deeper = (F.size(p) == F.size(t) - 1) & (p == head(t)) & (F.element_at(t, -1) == "1")
    fits = (t == F.array(F.lit("1"))) | F.coalesce(step | deeper, F.lit(False))
    marked = both.select("doc_id", "line_id", F.when(fits, 1).otherwise(-1).alias("list_item"))
    return lines.select("doc_id", "line_id").join(marked, ["doc_id", "line_id"], "left").select("doc_id", "line_id", F.coalesce("list_item", F.lit(0)).cast("long").alias("list_item"))


def prefix(text: Column) -> Column:
    """kind and prefix of a line: the first of bullets, letters, brackets, dotted numbers."""
    low = F.lower(strip(text))
    kinds = (("bullet", BULLET_PREFIX), ("letter", LETTER_PREFIX), ("bracket", BRACKET_PREFIX), ("dotted", DOTTED))
    case = None
    for kind, p in kinds:
        body = strip(F.regexp_extract(low, p, 0))
        one = F.struct(F.lit(kind).alias("kind"), (F.rtrim(body, F.lit(")")) if kind == "bracket" else body).alias("prefix"))
        case = F.when(low.rlike(p), one) if case is None else case.when(low.rlike(p), one)
    return case.otherwise(F.struct(F.lit("empty").alias("kind"), F.lit("").alias("prefix")))


def follows(a: Column, b: Column) -> Column:
    """Whether prefix b follows prefix a; both of the structs of prefix()."""
    return F.coalesce((a["kind"] == b["kind"]) & (a["kind"] != "empty") & same_kind_next(a["kind"], a["prefix"], b["prefix"]), F.lit(False))


def prefix_window(lines: DataFrame, width: int = 10, indent: str = "indentation") -> DataFrame:
    """For the width lines before and width - 1 after a line: shares with a like indent (as
    near as a tenth of the window's deviation and 1), with a prefix next to the line's own,
    and with both."""
    frame = order().rowsBetween(-width, width - 1)
    seen = lines.select("doc_id", "line_id", prefix(F.col("text")).alias("own"), F.col(indent).cast("double").alias("indent"))
    seen = seen.withColumn("near", F.collect_list(F.struct("line_id", "own", "indent")).over(frame)).withColumn("std", F.stddev_pop("indent").over(frame))
    others = F.filter("near", lambda x: x["line_id"] != F.col("line_id"))
    like = lambda x: F.abs(x["indent"] - F.col("indent")) <= 0.1 * F.col("std") + 1
    next_to = lambda x: follows(x["own"], F.col("own")) | follows(F.col("own"), x["own"])
    share = lambda cond: F.round(F.size(F.filter("others", cond)) / (F.size("others") + 1), 6)
    seen = seen.withColumn("others", others)
    return seen.select(
        "doc_id", "line_id", share(like).alias(f"same_indent_{width}"), share(next_to).alias(f"predecessor_num_{width}"), share(lambda x: like(x) & next_to(x)).alias(f"predecessor_num_same_indent_{width}")
    )


def paragraphs(lines: DataFrame) -> DataFrame:
    """Features of a line and its neighbours from boxes (x, y, width, height), capitals and
    bold shares; lines with bold_percent and color_dispersion."""
    w = order()
    c = F.col
    before, after = lambda x: F.lag(x).over(w), lambda x: F.lead(x).over(w)
    right, bottom, caps = c("x") + c("width"), c("y") + c("height"), upper_share(strip(c("text")))
    seen = lines.select("*", right.alias("right"), bottom.alias("bottom"), caps.alias("caps"))
    full = (c("bold_percent") == 1.0).cast("int")
    r = lambda x, n: F.round(x, 6).alias(n)
    return seen.select(
        "doc_id", "line_id", c("x").alias("indent"), (c("x") - before("x")).alias("indent_prev"), (after("x") - c("x")).alias("indent_next"), c("right").alias("indent_right"), (c("right") - before("right")).alias("indent_prev_right"),
        F.length(before("text")).cast("long").alias("prev_text_lens"), F.length("text").cast("long").alias("text_lens"), r(c("caps"), "upper_letters_percent"), (c("caps") == 1).cast("long").alias("is_capitalized"),
        (full != before(full)).cast("long").alias("is_bold_changed"), (full != after(full)).cast("long").alias("is_bold_changed_next"), r(F.abs(before("color_dispersion") - c("color_dispersion")), "color_dispersion_diff"),
        (c("y") - before("bottom")).alias("distance_prev"), (after("y") - c("bottom")).alias("distance_next"), c("height").alias("height"), r(c("height") / (after("height") + 1), "height_next"), r(c("height") / (before("height") + 1), "height_prev"),
    )


def quantiles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as quantiles in their document; nulls count as one below the least value."""
    for name in columns:
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast("double"), F.min(F.col(name).cast("double")).over(doc()) - 1))
    rank = lambda n: (F.rank().over(doc().orderBy(n)) - 1 + F.count("*").over(Window.partitionBy("doc_id", n)) / 2) / F.count("*").over(doc())
    return rows.withColumns({n: F.round(rank(n), 6) for n in columns})


def law(lines: DataFrame) -> DataFrame:
    """Features of law lines: what the line before ends with, lines since a named unit,
    distance to the first application, ends, quotes, brackets, years, shares of characters."""
    t = F.col("text")
    s, low = strip(t), F.lower(t)
    prev = F.lag("text").over(order())
    since = F.col("pos") - F.coalesce(F.last(F.when(s.rlike(NAMED), F.col("pos")), ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    application = F.lower(s).rlike(APPLICATION)
    length = F.length(s) + 1
    share = lambda klass: F.round(F.length(F.regexp_replace(s, klass, "")) / length, 6)
    depth = F.aggregate(F.regexp_extract_all(t, F.lit(r"[()]"), F.lit(0)), F.lit(0), lambda acc, x: F.when(x == "(", acc + 1).otherwise(F.greatest(acc - 1, F.lit(0))))
    rows = lines.withColumn("pos", (F.row_number().over(order()) - 1).cast("long"))
    return rows.select(
        "doc_id", "line_id", since.cast("long").alias("lines_from_named"), F.coalesce(F.col("pos") - F.min(F.when(application, F.col("pos"))).over(doc()), F.lit(0)).cast("long").alias("application"),
        flag(prev.rlike("[.;]$")).alias("prev_line_ends"), flag(prev.endswith(":")).alias("prev_ends_with_colon"), flag(F.lower(strip(prev)).startswith("статья")).alias("prev_starts_with_article"), flag(prev.rlike(r"^\s+$")).alias("prev_is_space"),
        F.regexp_count(t, F.lit(YEAR)).cast("long").alias("num_year_regexp"), *[flag(s.endswith(e)).alias(f"endswith_{n}") for n, e in (("dot", "."), ("semicolon", ";"), ("colon", ":"), ("comma", ","))],
        flag(s.rlike(r"^[({]")).alias("startswith_bracket"), depth.cast("long").alias("bracket_num"), flag(s.rlike("^[\"'«]")).alias("startswith_quote"), flag(low.contains("год")).alias("year_regexp"), flag(application).alias("regexp_application_begin"),
        *start_lengths(t, (NAMED,), "named"), *start_lengths(low, LAW_ITEMS, "item"), *start_lengths(low, (SUBITEM,), "subitem"),
        F.when(t.rlike(SUBITEM), F.ascii(strip(F.regexp_extract(t, SUBITEM, 0))) - ord("а")).otherwise(0).cast("long").alias("subitem_regexp_num"),
        share(r"\P{Lu}").alias("supper_percent"), share(r"\P{L}").alias("letter_percent"), share(r"\P{N}").alias("number_percent"), flag(s.rlike(r"^\p{Lu}")).alias("is_capitalized"),
    )


def in_quotes(lines: DataFrame) -> DataFrame:
    """doc_id, line_id, quoted: 1 for lines of a quotation that begins with a quote before an
    item or named unit and ends with its quote at the end of a line; a quotation that is
    never closed counts for nothing. A fold over the document's lines in order."""
    s = strip(F.col("text"))
    body = F.substring(s, F.lit(2), F.length(s))
    opens = s.rlike("^[\"'«]") & (body.rlike(LAW_ITEMS[0]) | body.rlike(LAW_ITEMS[1]) | body.rlike(SUBITEM) | body.rlike(NAMED))
    close = F.when(s.startswith("«"), "»").otherwise(F.substring(s, 1, 1))
    ends = [F.when(s.rlike(f"{q}[.;]?$"), F.lit(q)).otherwise(F.lit("")) for q in ('"', "'", "»")]
    rows = lines.select("doc_id", F.struct(F.col("line_id").cast("long").alias("line_id"), F.when(opens, close).otherwise("").alias("open"), F.concat(*ends).alias("ends")).alias("x"))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<bigint>").alias("held"), F.array().cast("array<bigint>").alias("done"))

    def step(acc, x):
        within = acc["open"] != ""
        held = F.array_append(acc["held"], x["line_id"])
        closed = within & x["ends"].contains(acc["open"])
        alone = ~within & (x["open"] != "") & x["ends"].contains(x["open"])
        begun = ~within & (x["open"] != "")
        none = F.array().cast("array<bigint>")
        return F.struct(
            F.when(closed, "").when(within, acc["open"]).when(alone, "").when(begun, x["open"]).otherwise("").alias("open"),
            F.when(closed, none).when(within, held).when(alone, none).when(begun, F.array(x["line_id"])).otherwise(none).alias("held"),
            F.when(closed, F.concat(acc["done"], held)).when(alone, F.array_append(acc["done"], x["line_id"])).otherwise(acc["done"]).alias("done"),
        )

    found = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("doc_id", "xs", F.aggregate("xs", start, step)["done"].alias("done"))
    return found.select("doc_id", F.explode("xs").alias("x"), "done").select("doc_id", "x.line_id", F.array_contains("done", F.col("x.line_id")).cast("long").alias("quoted"))


def thesis(lines: DataFrame) -> DataFrame:
    """Features of thesis lines: words of their own, starts, depth, lengths."""
    t = F.col("text")
    s = strip(t)
    tight = F.regexp_replace(F.lower(s), r"(?U)\s", "")
    any_start = tight.startswith(NAMED_STARTS[0]) | tight.startswith(NAMED_STARTS[1])
    depth = F.when(F.lower(s).rlike(DOTTED), F.size(numbers_of(strip(F.regexp_extract(F.lower(s), DOTTED, 0))))).otherwise(0)
    return lines.select(
        "doc_id", "line_id", *[tight.isin(*words).cast("long").alias(n) for n, words in (("is_title", THESIS_TITLES), ("is_title_keyword", TITLE_WORDS), ("is_named_item", NAMED_ITEMS))], any_start.cast("long").alias("named_item_start"),
        sum((tight.contains(w).cast("long") for w in RAW_WORDS), F.lit(0).cast("long")).alias("is_raw_text"), *start_lengths(t, (ITEM, DOTTED, r"^\s*\d+\s")),
        F.length(F.regexp_replace(tight, "[^()]", "")).cast("long").alias("brackets_number"), ((F.lower(s) == s) & (F.upper(s) != s)).cast("long").alias("is_lower"), depth.cast("long").alias("dotted_depth"),
        F.length(F.lower(s)).cast("long").alias("text_length"), F.size(F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")).cast("long").alias("words_number"),
    )


#: Titles of tables of contents without blanks, in lower case; an item and its page.
TOC_TITLES = ("tableofcontents", "contents", "tableofcontentspage", "содержание", "оглавление", "tabledesmatières", "tabledesmatieres", "sommaire", "indice", "índice", "contenidos", "tabladecontenido")
TOC_ITEM = r"^(.*[^\s.…])?[….\s]+(\d{1,3})(-\d{1,3})?$"
TOC_WINDOW = 5


def contents(lines: DataFrame) -> DataFrame:
    """doc_id, item, first_line, last_line, page, text of the items of a document's table of
    contents. Lines after the last title (of those before which fewer than 6 items are) are
    candidates; gaps of fewer lines than the window are filled, and lines without a page
    belong to the item after them. More than 6 items whose pages don't fall make a table."""
    t = F.col("text")
    upto = order().rowsBetween(Window.unboundedPreceding, -1)
    title = F.lower(F.regexp_replace(t, r"(?U)[\s:]", "")).isin(*TOC_TITLES)
    s = strip(t)
    rows = lines.select("doc_id", "line_id", "text", title.alias("title"), (s != "").alias("some"), s.rlike(r"^\d+$").alias("digits"), F.regexp_extract(s, TOC_ITEM, 2).try_cast("long").alias("page"), s.rlike(TOC_ITEM).alias("item"))
    mark = F.col("item") & F.col("some") & ~F.col("digits") & ~F.col("title") & (F.length("text") > 5)
    rows = rows.withColumn("mark", mark.cast("int"))
    # a title starts anew while fewer than 6 items were seen since the last start: a fold over titles alone
    titles = rows.withColumn("before", F.coalesce(F.sum("mark").over(upto), F.lit(0))).where("title").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "before"))).alias("ts"))
    start = F.struct(F.lit(-1).cast("long").alias("line_id"), F.lit(0).cast("long").alias("before"))
    last = F.aggregate("ts", start, lambda acc, x: F.when(x["before"] - acc["before"] < 6, F.struct(x["line_id"].cast("long").alias("line_id"), x["before"].cast("long").alias("before"))).otherwise(acc))
    begun = rows.join(titles.select("doc_id", last["line_id"].alias("from")), "doc_id", "left").where((F.col("line_id") > F.coalesce("from", F.lit(-1))) & F.col("some") & ~F.col("digits"))
    w = order()
    seen = begun.select("*", (F.row_number().over(w) - 1).alias("k"), F.count("*").over(doc()).alias("n"), F.coalesce(F.sum("mark").over(upto), F.lit(0)).alias("earlier"))
    ahead = F.coalesce(F.max("mark").over(w.rowsBetween(0, TOC_WINDOW - 1)), F.lit(0))
    later = F.coalesce(F.max("mark").over(w.rowsBetween(1, TOC_WINDOW - 1)), F.lit(0))
    seen = seen.select("*", ahead.alias("ahead"), later.alias("later")).where(F.col("n") > TOC_WINDOW)
    over = (F.col("earlier") > 5) & (F.col("ahead") == 0)
    seen = seen.withColumn("over", F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = seen.where((F.col("k") < F.col("n") - TOC_WINDOW) & (F.col("over") == 0) & (((F.col("ahead") == 1) & (F.col("earlier") > 0)) | ((F.col("mark") == 1) & (F.col("later") == 1))))
    kept = kept.withColumn("own", F.sum(F.col("item").cast("int")).over(w) - F.col("item").cast("int"))
    items = kept.groupBy("doc_id", F.col("own").alias("item")).agg(F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"), F.max(F.when(F.col("item"), F.col("page"))).alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), "").alias("text")).where("page IS NOT NULL")
    by = Window.partitionBy("doc_id").orderBy("item")
    items = items.select("*", F.coalesce(F.col("page") < F.lag("page").over(by), F.lit(False)).alias("falls"))
    every = items.select("*", F.max("falls").over(doc()).alias("bad"), F.count("*").over(doc()).alias("items"))
    return every.where("items > 6 AND NOT bad").select("doc_id", "item", "first_line", "last_line", "page", "text")


def scan_layout(lines: DataFrame, dpi: int = 300) -> DataFrame:
    """Layout of scanned lines (x, y, width, height, page_id): the left bound is the lesser of
    the document's two most frequent left edges; indentation in twentieths of a point, font
    size from the height, spacing as per cent of the document's median height."""
    popular = lines.groupBy("doc_id", "x").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(doc().orderBy(F.desc("n"), "x"))).where("r <= 2").groupBy("doc_id").agg(F.min("x").alias("bound"))
    per = lines.groupBy("doc_id").agg(F.median("height").alias("mid"))
    rows = lines.join(popular.join(per, "doc_id"), "doc_id")
    above = F.lag(F.col("y") + F.col("height")).over(Window.partitionBy("doc_id", "page_id").orderBy("line_id"))
    return rows.select(
        "doc_id", "line_id", F.greatest(F.round((F.col("x") - F.col("bound")) * 1440 / dpi), F.lit(0)).cast("long").alias("indentation"), F.round(F.col("height") * 72 / dpi).cast("long").alias("size"),
        F.coalesce(F.floor(F.try_divide((F.col("y") - above) * 100, "mid")), F.lit(0)).cast("long").alias("spacing"),
    )
