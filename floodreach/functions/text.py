"""Text built from results: isolation ranges, notices, countdowns, in English and Bengali."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Digits, month names and the sentences, whose {slots} are filled below.
_DIGITS, _BN_DIGITS = "0123456789", "০১২৩৪৫৬৭৮৯"
_BN_MONTHS = {5: "মে", 6: "জুন", 7: "জুলাই"}
_RANGE = {"between": "isolated between {from} and {to}", "before": "isolated on or before {to}"}
_NOTICE = {
    "en": {"between": "{from} - {to}", "before": "on or before {to}", "route": "{km} km by road to {shelter}", "no route": "not available", "no shelter": "None",
           "all": "Provisional: {name} may be isolated during {when}. Last safe route: {route}. Follow official flood alerts."},
    "bn": {"between": "{from} - {to}", "before": "{to} বা তার আগে", "route": "সড়কপথে {km} কিমি", "no route": "জানা নেই", "no shelter": "জানা নেই",
           "all": "সতর্কতা (পরীক্ষামূলক): {name} এর সড়ক যোগাযোগ {when} এর মধ্যে বিচ্ছিন্ন হতে পারে। নিরাপদ পথ: {route}। নিকটতম আশ্রয়কেন্দ্র: {shelter}। সরকারি সতর্কবার্তা মেনে চলুন।"},
}


def fill(pattern: str, **slots: Column) -> Column:
    """``pattern`` with each {slot} replaced by its column; null where one of its columns is null."""
    parts = re.split(r"\{(\w+)\}", pattern)  # text and slot names in turn
    return F.concat(*[slots[part] if i % 2 else F.lit(part) for i, part in enumerate(parts) if part])


def bengali_number(text) -> Column:
    return F.translate(text.cast("string"), _DIGITS, _BN_DIGITS)


def format_day(day, lang: str = "en") -> Column:
    """Day and short month; a hyphen where there is no day."""
    text = F.date_format(day, "dd MMM")
    if lang == "bn":
        names = F.create_map(*[F.lit(v) for pair in _BN_MONTHS.items() for v in pair])
        text = fill("{day} {month}", day=bengali_number(F.dayofmonth(day)), month=F.coalesce(names[F.month(day)], F.date_format(day, "MMM")))
    return F.coalesce(text, F.lit("-"))


def _span(patterns: dict, last_connected, start, end) -> Column:
    """The time of isolation: open to the past where no connected day is known."""
    slots = {"from": start, "to": end}
    return F.when(last_connected.isNull(), fill(patterns["before"], **slots)).otherwise(fill(patterns["between"], **slots))


def isolation_range_text(outcome, last_connected, earliest, first) -> Column:
    start, end = F.date_format(earliest, "dd MMM"), F.date_format(first, "dd MMM")
    return F.when(outcome == "isolated", _span(_RANGE, last_connected, start, end)).otherwise(F.when(outcome.isNotNull(), ""))


def notice_text(name, name_bn, last_connected, earliest, first, route_km, shelter, lang: str = "en") -> Column:
    """Short provisional notice for one settlement; the route part depends on a route being known."""
    said, km = _NOTICE[lang], F.format_string("%.1f", route_km)
    if lang == "bn":
        name, km, shelter = F.coalesce(F.nullif(name_bn, F.lit("")), name), bengali_number(km), F.nullif(shelter, F.lit(""))
    shelter = F.coalesce(shelter, F.lit(said["no shelter"]))
    route = F.when(route_km.isNull(), said["no route"]).otherwise(fill(said["route"], km=km, shelter=shelter))
    return fill(said["all"], name=name, when=_span(said, last_connected, format_day(earliest, lang), format_day(first, lang)), route=route, shelter=shelter)


def supply_left(deadline, earliest, day) -> tuple[Column, Column]:
    """Days of supply left on ``day`` (null before isolation can have begun) and whether that is urgent."""
    left = F.when(day >= earliest, F.datediff(deadline, day))
    return left, left <= 2
