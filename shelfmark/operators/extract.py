"""Course cards from HTML and harvest assembly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.operators.common import first_per

UDEMY = "https://www.udemy.com"
COURSERA = "https://www.coursera.org"
NA = "N/A"


def visible_text(html: Column) -> Column:
    """Scripts, styles and comments out, then tags and entities out."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return C.clean_text(bare)


def inner(html: Column, tag: str, attr: str = "") -> Column:
    """Text of the first element with this tag (and an attribute text), NULL when absent."""
    mark = rf"[^>]*{attr}[^>]*" if attr else r"(?:\s[^>]*)?"
    found = F.regexp_extract(html, rf"(?is)<{tag}{mark}>(.*?)</{tag}>", 1)
    return F.nullif(C.clean_text(found), F.lit(""))


def first_link(html: Column, part: str = "") -> Column:
    found = F.regexp_extract(html, rf'(?is)<a\s[^>]*href="([^"]*{part}[^"]*)"', 1)
    return F.nullif(found, F.lit(""))


#: Parts of a marked-up card: the tag, an attribute, what it holds, and whether it is all of it.
CARD_PARTS = {
    "title": ("h2", "", "", False),
    "instructor": ("span", "data-purpose", "visible-instructors", False),
    "rating": ("span", "data-purpose", "rating-number", True),
    "tags": ("ul", "class", "tag-list", False),
    "current_price": ("div", "data-purpose", "course-price-text", True),
    "original_price": ("div", "data-purpose", "course-old-price-text", True),
}
CARD_TAG, CARD_CLASS, CARD_LINK = "section", "course-product-card", "/course/"
#: Tags that have no end and hold nothing.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


class CardWalker(HTMLParser):
    """The cards of a page in one walk over its tags.

    A card ends with the element it began with, whatever elements of the same tag are inside, and so
    does each of its parts; the first element of a kind counts. Elements that are never closed end
    with the card.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict[str, str]] = []
        self.card: dict[str, str] | None = None
        self.open: list[str] = []  # tags inside the card, from the card itself on
        self.parts: dict[str, int] = {}  # parts that are open, with their depth

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        if self.card is None:
            if tag == CARD_TAG and CARD_CLASS in at.get("class", ""):
                self.card, self.open, self.parts = {}, [tag], {}
            return
        if tag == "a" and CARD_LINK in at.get("href", ""):
            self.card.setdefault("link", at["href"])
        self._separate()
        if tag in VOID_TAGS:
            return
        self.open.append(tag)
        for part, (name, attr, text, whole) in CARD_PARTS.items():
            held = at.get(attr, "")
            if tag == name and part not in self.card and (
                    held == text if whole else text in held):
                self.card[part] = ""
                self.parts[part] = len(self.open)

    def handle_endtag(self, tag: str) -> None:
        if self.card is None or tag not in self.open:
            return
        while self.open.pop() != tag:
            pass
        self._separate()
        self.parts = {p: d for p, d in self.parts.items() if d <= len(self.open)}
        if not self.open:
            self._end()

    def handle_data(self, data: str) -> None:
        for part in self.parts:
            self.card[part] += data

    def _separate(self) -> None:
        """Texts of neighbouring elements do not run together."""
        for part in self.parts:
            self.card[part] += " "

    def _end(self) -> None:
        if self.card is not None:
            self.cards.append(self.card)
        self.card = None

    def walk(self, page: str) -> list[dict[str, str]]:
        self.feed(page)
        self.close()
        self._end()
        return self.cards


def walk_cards(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """The marked-up cards of every page: key, pos, link and the texts of `CARD_PARTS`, NULL
    where a card has no such part. A NULL page has none."""
    names = ["link", *CARD_PARTS]
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, page in enumerate(batch.column(1)):
                cards = CardWalker().walk(page.as_py() or "")
                at += [i] * len(cards)
                found += [(n, c) for n, c in enumerate(cards)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())),
                 pa.array([n for n, _ in found], pa.int32()),
                 *[pa.array([c.get(p) for _, c in found], pa.string()) for p in names]],
                names=["key", "pos", *names])

    out = pages.select(F.col(key).alias("key"), html).mapInArrow(
        run, f"key {kind}, pos int, " + ", ".join(f"{n} string" for n in names))
    return out.withColumnRenamed("key", key)


def tagged_cards(cards: DataFrame) -> DataFrame:
    """A13, marked-up cards: the fields of what `walk_cards` found. Cards without a link are
    dropped."""
    def text(part: str) -> Column:
        return F.nullif(C.clean_text(F.col(part)), F.lit(""))
    tags = text("tags")
    out = cards.select(*[c for c in cards.columns if c not in ("link", *CARD_PARTS)], *[
        x.alias(name) for name, x in {
            "title": F.coalesce(text("title"), F.lit(NA)),
            "course_url": C.absolute_url(F.col("link"), UDEMY),
            "instructor": F.coalesce(text("instructor"), F.lit(NA)),
            "rating": text("rating").try_cast("double"),
            "reviews": C.review_count(tags),
            "duration_hours": C.total_hours(tags),
            "lectures": C.lecture_count(tags),
            "level": F.coalesce(F.when(tags.isNotNull(), C.tag_level(tags)), F.lit(NA)),
            "current_price": F.coalesce(text("current_price"), F.lit(NA)),
            "original_price": F.coalesce(text("original_price"), F.lit(NA))}.items()])
    return out.filter(F.col("course_url").isNotNull())


def text_cards(cards: DataFrame, html: str = "card", title_tags: Sequence[str] = ("h3", "h2")
               ) -> DataFrame:
    """A13, loosely marked cards: fields are read from the visible text."""
    h = F.col(html)
    shown = cards.withColumn("_text", visible_text(h))
    t = F.col("_text")
    link = first_link(h)
    return shown.withColumns({
        "title": F.coalesce(*[inner(h, tag) for tag in title_tags]),
        "course_url": F.when(link.startswith("/"), F.concat(F.lit(COURSERA), link))
        .otherwise(link),
        "rating": C.rating_in_text(inner(h, "span", 'aria-label="[^"]*rating')),
        "num_reviews": C.review_count_suffixed(t),
        "level": C.card_level(t),
        "price": C.card_price(t),
        "description": inner(h, "p"),
    }).drop("_text")


def assemble(records: DataFrame, topic: str, url: str, order: Sequence[str], limit: int
             ) -> DataFrame:
    """Per topic drop repeated urls and rows without one, then keep the first `limit`."""
    by = [F.col(c) for c in order]
    fresh = first_per(records.filter(F.col(url).isNotNull()), [topic, url], by)
    return first_per(fresh, [topic], by, limit, "topic_rank")


def harvest_summary(records: DataFrame, by: str = "platform") -> DataFrame:
    """Rows per platform, and of all."""
    return (records.groupingSets([[by], []], by)
            .agg(F.grouping(by).alias("_all"), F.count(F.lit(1)).alias("n"))
            .select(F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col(by))
                    .alias(by), "n"))


def harvest_preview(records: DataFrame, by: str = "platform", order: str = "ingest_seq", n: int = 3
                    ) -> DataFrame:
    """The first rows of every platform, with their place."""
    return first_per(records.filter(F.col(by).isNotNull()), [by], [F.col(order)], n, "place")
