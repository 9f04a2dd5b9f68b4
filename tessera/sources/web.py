"""Readable text, shapes and addresses of web pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is not text, and what an entity stands for.
SILENT = ("script", "style", "noscript")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))
BLOCKED = ("captcha", "access denied", "verify you are human", "login required")
TITLE = r"(?is)<title>(.*?)</title>"
#: Patterns and what takes their place, in order: silent elements, tags, a tag without an end, bare brackets.
STEPS = (*((rf"(?is)<{s}( [^>]*)?>.*?(</{s}[^>]*>|\z)", " ") for s in SILENT), ("<[A-Za-z/!?][^>]*>", " "), (r"(?s)<[A-Za-z/!?].*\z", ""), ("<", " "))
EDGES, BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$", " {2,}"


def readable(html: Column) -> Column:
    """The text of a page: its lines without markup, trimmed and squeezed, blank ones dropped."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    for entity, by in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(by))
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, EDGES, ""), BLANKS, " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def shape(html: Column) -> Column:
    """What a response is: empty-body, blocked, markup, json or unknown."""
    low = F.lower(F.coalesce(html, F.lit("")))
    trimmed = F.regexp_replace(low, EDGES, "")
    return F.when(trimmed == "", "empty-body").when(low.rlike("|".join(BLOCKED)), "blocked").when(low.rlike("<html|<!doctype|<script"), "markup").when(trimmed.rlike(r"^[{\[]"), "json").otherwise("unknown")


def title_key(html: Column) -> Column:
    """The letters and digits of a page's title, in lower case; null below six."""
    key = F.regexp_replace(F.lower(F.regexp_extract(html, TITLE, 1)), "[^a-z0-9à-öø-ÿ]", "")
    return F.when(F.length(key) >= 6, key)


#: Signs of pages that hold no text of a paper: our own lists.
WALLS = (("login", "sign in|log in|login required|please log|请登录"), ("paywall", "purchase|subscribe to read|buy this article|购买|付费"), ("captcha", "captcha|verify you are human|are you a robot|验证码"), ("blocked", "access denied|forbidden|too many requests|访问受限"), ("missing", "not found|no longer available|page does not exist|页面不存在"))


def wall(html: Column, least: int = 400) -> Column:
    """What stands before a page's text, login, paywall, captcha, blocked or missing; thin for a page of fewer characters, else null."""
    text = readable(html)
    low = F.lower(text)
    short = F.length(text) < least
    found = F.lit(None).cast("string")
    for name, pattern in reversed(WALLS):
        found = F.when(low.rlike(pattern), name).otherwise(found)
    return F.when(short, F.coalesce(found, F.lit("thin")))


def frame(body: Column) -> Column:
    """The shape of a framed answer, from its first byte: message, trailer, markup, json or unknown."""
    first = F.substring(body, 1, 1)
    return F.when(F.length(body) < 5, "unknown").when(first == F.lit(b"\x00"), "message").when(first == F.lit(b"\x80"), "trailer").when(first == F.lit(b"<"), "markup").when(first.isin(F.lit(b"{"), F.lit(b"[")), "json").otherwise("unknown")


def section(text: Column, title: str) -> Column:
    """What stands behind a heading line of a readable page, up to the next short line that ends with a colon; empty for none."""
    return F.coalesce(F.regexp_extract(text, rf"(?im)^\s*{title}\s*:?\s*$\n([\s\S]*?)(?=^\S.{{0,40}}:\s*$|\z)", 1), F.lit(""))
