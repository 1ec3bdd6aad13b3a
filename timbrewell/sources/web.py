"""Saved web pages and JSON: lists of games, packs with composers, composer look-ups, the published dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrewell.functions.naming import clean_game, pack_title
from timbrewell.schema import DATASET

# Composers of well-known games, for use where nothing was found.
KNOWN_COMPOSERS = [
    ("Sonic the Hedgehog", "Masato Nakamura", "Japan"),
    ("Streets of Rage", "Yuzo Koshiro", "Japan"),
    ("Streets of Rage 2", "Yuzo Koshiro", "Japan"),
    ("Shinobi III", "Yuzo Koshiro", "Japan"),
    ("Golden Axe", "Hiroshi Kawaguchi", "Japan"),
    ("Phantasy Star IV", "Izuho Takeuchi", "Japan"),
    ("Gunstar Heroes", "Norio Hanzawa", "Japan"),
    ("Comix Zone", "Howard Drossin", "USA"),
    ("Ecco the Dolphin", "Spencer Nilsen", "USA"),
    ("ToeJam & Earl", "John Baker", "USA"),
]
# In order of rank, phrases that name a composer; words without which a page is passed over; words that tell a nationality.
COMPOSER_PHRASES = (
    r"composed by ([A-Z][a-z]+ [A-Z][a-z]+)",
    r"music by ([A-Z][a-z]+ [A-Z][a-z]+)",
    r"soundtrack by ([A-Z][a-z]+ [A-Z][a-z]+)",
    r"([A-Z][a-z]+ [A-Z][a-z]+) composed",
)
MUSIC_WORDS = ("composer", "music", "soundtrack")
NATIONALITIES = (("Japan", ("japanese", "japan")), ("USA", ("american", "united states")), ("UK", ("british", "uk")), ("Europe", ("european",)))
_ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a>"


def links(html: Column) -> Column:
    """Texts of all links of flat markup, without inner tags."""
    return F.transform(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))


def link_targets(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="([^"]*)"'), F.lit(1))


class _Lists(HTMLParser):
    """Links in list items: those in div.mobile-columns, and the first of each other item."""

    VOID = {"br", "img", "input", "hr", "meta", "link", "source", "wbr"}

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, str, str]] = []
        self.columns: list[str] = []
        self.first: list[tuple[bool, str]] = []
        self.text: list[str] | None = None
        self.taken: list[bool] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        a = dict(attrs)
        self.open.append((tag, a.get("class") or "", a.get("id") or ""))
        if tag == "li":
            self.taken.append(False)
        elif tag == "a":
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        if tag == "a" and self.text is not None:
            name, self.text = "".join(x.strip() for x in self.text), None
            in_item = any(t == "li" for t, _, _ in self.open)
            if in_item and any(t == "div" and "mobile-columns" in c.split() for t, c, _ in self.open):
                self.columns.append(name)
            if in_item and any(t == "ul" for t, _, _ in self.open):
                if self.taken and not self.taken[-1]:
                    self.taken[-1] = True
                    self.first.append((any(i == "mw-content-text" for _, _, i in self.open), name))
        while self.open:
            t, _, _ = self.open.pop()
            if t == "li" and self.taken:
                self.taken.pop()
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)


def listed(html: str | None) -> list[str]:
    """Raw link texts of the page's list of games."""
    parser = _Lists()
    parser.feed(html or "")
    if parser.columns:
        return parser.columns
    inside = [n for within, n in parser.first if within]
    return inside or [n for _, n in parser.first]


def _listed_udf() -> Callable[..., Column]:
    """Nested markup is beyond regular expressions, so a parser runs over Arrow batches."""

    def run(html: pd.Series) -> pd.Series:
        return html.map(listed)

    return F.pandas_udf(run, "array<string>")


def games_of_pages(pages: DataFrame) -> DataFrame:
    """Distinct cleaned games on the pages, sorted."""
    names = pages.select(F.explode(_listed_udf()("html")).alias("raw")).select(clean_game(F.col("raw")).alias("Game"))
    return names.where("Game IS NOT NULL").distinct().orderBy("Game")


def first_with_rows(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that opens and has rows; the last one if none has."""
    out = None
    for source in sources:
        try:
            out = source()
            if not out.isEmpty():
                return out
        except Exception as missing:  # noqa: BLE001  a source that can't be read gives way to the next
            failed = missing
    if out is None:
        raise failed
    return out


def envelope_html(payload: Column) -> Column:
    """HTML of a JSON reply: parse.text, or its member '*'."""
    text = F.get_json_object(payload, "$.parse.text")
    return F.coalesce(F.from_json(text, "map<string,string>").getItem("*"), text)


def packs(pages: DataFrame, source: str = "VGMrips", max_pages: int | None = None) -> DataFrame:
    """Game, Composers and Source of saved listing pages (page_id, html): a section for each h2."""
    rows = pages if max_pages is None else pages.where(F.col("page_id") <= max_pages)
    parts = rows.select("page_id", F.posexplode(F.split("html", r"(?i)<h2\b[^>]*>")).alias("place", "part")).where("place > 0")
    title = F.regexp_replace(F.substring_index("part", "</h2>", 1), r"<[^>]*>", "")
    names = F.regexp_extract_all("part", F.lit(r'(?is)<a\b[^>]*href="[^"]*/packs/composer/[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    names = F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", ""))), lambda x: x != ""))
    out = parts.select("page_id", "place", pack_title(title).alias("Game"), names.alias("Composers"), F.lit(source).alias("Source"))
    return out.where(F.col("Game").isNotNull() & (F.size("Composers") > 0))


def walked(pages: DataFrame) -> DataFrame:
    """The listing pages that a walk from page 0 visits: it ends with a missing page, with one that has no link to a
    next one, or with the one by which as many packs were found as the listing says there are.
    """
    found = packs(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("_packs"))
    texts = F.transform(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)), lambda x: F.regexp_replace(x, r"<[^>]*>", ""))
    more = F.exists(texts, lambda x: x.rlike(r"(?i)next|»|&raquo;"))
    total = F.regexp_extract("html", r"(?i)Packs[^<]*of\s+(\d+)\s+total", 1)
    # a line of numbers for each page; the pages themselves are joined back by id
    marks = pages.select("page_id", more.alias("_more"), F.nullif(total, F.lit("")).cast("long").alias("_total")).join(found, "page_id", "left")
    so_far = Window.orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select("page_id", (~F.col("_more") | F.coalesce(F.sum(F.coalesce("_packs", F.lit(0))).over(so_far) >= F.col("_total"), F.lit(False))).alias("_last"), F.row_number().over(Window.orderBy("page_id")).alias("_n"))
    ends = marks.agg(F.min(F.when(F.col("_last"), F.col("page_id"))).alias("_end"), F.min(F.when(F.col("_n") - 1 != F.col("page_id"), F.col("_n") - 2)).alias("_gap"))
    return pages.join(F.broadcast(ends), F.col("page_id") <= F.least(F.coalesce("_end", F.lit((1 << 62))), F.coalesce("_gap", F.lit((1 << 62))))).drop("_end", "_gap")


def pack_rows(found: DataFrame) -> DataFrame:
    """One row for each game and composer."""
    return found.select("page_id", "place", "Game", F.posexplode("Composers").alias("n", "Composer"), "Source")


def tells_of_music(text: Column, about: Column | None = None) -> Column:
    """Whether the summary or the first 2,000 characters speak of a composer or of music."""
    head = F.substring(text, 1, 2000)
    low = F.lower(head if about is None else F.concat_ws(" ", F.coalesce(about, F.lit("")), head))
    out = F.lit(False)
    for word in MUSIC_WORDS:
        out |= low.contains(word)
    return out


def composer_in(text: Column, about: Column | None = None) -> Column:
    """The composer that the first 3,000 characters name, by the first phrase that occurs, on pages that tell of music."""
    head = F.substring(text, 1, 3000)
    return F.when(tells_of_music(text, about), F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in COMPOSER_PHRASES]))


def nationality_in(text: Column) -> Column:
    """By the first group of words that occurs anywhere, inside other words too."""
    low, out = F.lower(text), F.lit("Unknown")
    for name, words in reversed(NATIONALITIES):
        hit = F.lit(False)
        for w in words:
            hit |= low.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def look_up(games: DataFrame, articles: DataFrame, source: str = "Wikipedia") -> DataFrame:
    """Game, Composer, Nationality and Source from saved articles (Game, rank, text, about): the first that names one."""
    found = articles.withColumn("Composer", composer_in(F.col("text"), F.col("about"))).where("Composer IS NOT NULL")
    first = found.groupBy("Game").agg(F.min_by(F.struct("Composer", "about"), "rank").alias("r"))
    named = first.select("Game", "r.Composer", nationality_in(F.coalesce("r.about", F.lit(""))).alias("Nationality"), F.lit(source).alias("Source"))
    return games.select("Game").distinct().join(named, "Game")


def known_composers(spark: SparkSession, games: DataFrame) -> DataFrame:
    """The fixed table, for games that occur."""
    table = spark.createDataFrame(KNOWN_COMPOSERS, "Game string, Composer string, Nationality string").withColumn("Source", F.lit("Manual"))
    return table.join(games.select("Game").distinct(), "Game", "left_semi")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Presets of a published dataset file."""
    return spark.read.schema(DATASET).option("multiLine", "true").json(path).select(F.explode("presets").alias("p")).select("p.*")


def pages_of(texts: Iterator[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "page_id long, html string")
