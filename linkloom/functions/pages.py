"""Title, description and icon of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from linkloom.functions.url import scheme_error

META = StructType([StructField(n, StringType()) for n in ("title", "description", "favicon_url")])


class _Head(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.icon: str | None = None
        self.title: str | None = None
        self._open = False

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for key in (own.get("property"), own.get("name")):
                if key and own.get("content"):
                    self.meta.setdefault(key, own["content"])
        elif tag == "link" and self.icon is None and "icon" in own.get("rel", "").lower():
            self.icon = own.get("href", "")
        elif tag == "title" and self.title is None:
            self._open, self.title = True, ""

    def handle_endtag(self, tag):
        if tag == "title":
            self._open = False

    def handle_data(self, data):
        if self._open:
            self.title += data


def page_head(html: str, base: str) -> tuple[str | None, str | None, str | None]:
    """Open-graph title or the title element; open-graph or plain description; the first icon, or the host's default."""
    head = _Head()
    head.feed(html or "")
    title = head.meta.get("og:title") or head.title or None
    said = head.meta.get("og:description") or head.meta.get("description")
    if head.icon:
        icon = urljoin(base, head.icon)
    else:
        at = urlsplit(base)
        icon = f"{at.scheme}://{at.netloc}/favicon.ico" if at.scheme and at.netloc else None
    return title.strip() if title else None, said.strip() if said else None, icon


@pandas_udf(META)
def page_metadata(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    rows = [page_head(h, b) for h, b in zip(html.fillna(""), base.fillna(""), strict=True)]
    return pd.DataFrame(rows, columns=["title", "description", "favicon_url"], dtype=object)


def native_title(html: Column) -> Column:
    """The title element's text as it stands, without its entities resolved; null for none."""
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def enrich(pages: DataFrame) -> DataFrame:
    """pages (url, html) with title, description, favicon_url and error; pages of other schemes aren't parsed."""
    error = scheme_error(F.col("url"))
    df = pages.withColumns({"error": error, "_meta": F.when(error.isNull(), page_metadata("html", "url"))})
    return df.select(*pages.columns, "_meta.title", "_meta.description", "_meta.favicon_url", "error")
