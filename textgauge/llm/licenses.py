"""License scan by ordered signature rules, with SQL functions only.

A text is taken as lower-case words. Texts without a key word of any rule are done after one look. In the others each
key word (such as "license", "gpl" or "cc") is looked at with REACH words on either side; no rule spans more, so all
matches that hold the key word lie in that stretch. Equal stretches of a text are looked at once. In a stretch the
rules whose own key is in it are matched. Of the matches that hold the key word, one is dropped if another contains its
interval and comes first in the order of priority, then length, then place, then label.

There are four kinds of rules for each license, in this order: SPDX tags, grants ("licensed under ..."), links, and
names. The rules are made from one table of licenses, of which each row gives the words of the tag and of the name.

Everything happens inside a row: no shuffle, and the work grows with the length of the text.

Defined cases: a null or empty text has no words and no labels; repeated rows and rows without id are reported each;
an empty table gives an empty result; further columns are ignored. Stated phrases always count, whatever the rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stated phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REACH = 14

#: Label, words of the SPDX tag, and the name as a pattern over words.
LICENSES = [
    ("mit", "mit", "(?:mit|expat)(?: style| expat| x11)? licen[sc]e"),
    ("mit-0", "mit 0", "mit (?:no attribution|0) licen[sc]e"),
    ("apache-2", "apache 2 0", "apache(?: software)? licen[sc]e(?: version)? (?:v ?)?2(?: 0)?|apache (?:v ?)?2(?: 0)? licen[sc]e"),
    ("apache-1.1", "apache 1 1", "apache(?: software)? licen[sc]e(?: version)? 1 1"),
    ("apache-1", "apache 1 0", "apache(?: software)? licen[sc]e(?: version)? 1 0"),
    ("gpl-1", "gpl 1 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl)(?: version)? (?:v ?)?1(?: 0)?|gplv1"),
    ("gpl-2", "gpl 2 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl)(?: version)? (?:v ?)?2(?: 0)?|gplv2"),
    ("gpl-3", "gpl 3 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl)(?: version)? (?:v ?)?3(?: 0)?|gplv3"),
    ("gpl", "gpl", "gnu general public licen[sc]e|gnu gpl|gpl licen[sc]e"),
    ("lgpl-2", "lgpl 2 0(?: only| or later)?", "(?:gnu )?(?:library general public licen[sc]e|lgpl)(?: version)? (?:v ?)?2(?: 0)?|lgplv2"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version)? (?:v ?)?2 1|lgplv2 1"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version)? (?:v ?)?3(?: 0)?|lgplv3"),
    ("lgpl", "lgpl", "gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl licen[sc]e"),
    ("agpl-3", "agpl 3 0(?: only| or later)?", "(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version)? (?:v ?)?3(?: 0)?|agplv3"),
    ("agpl", "agpl", "(?:gnu )?affero general public licen[sc]e|gnu agpl|agpl licen[sc]e"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?", "gnu free documentation licen[sc]e"),
    ("bsd-2", "bsd 2 clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[sc]e"),
    ("bsd-3", "bsd 3 clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e"),
    ("bsd-4", "bsd 4 clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd) licen[sc]e"),
    ("bsd-0", "0bsd", "(?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause) licen[sc]e"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e"),
    ("mpl-1.1", "mpl 1 1", "mozilla public licen[sc]e(?: version)? (?:v ?)?1 1|mpl 1 1 licen[sc]e"),
    ("mpl-2", "mpl 2 0", "mozilla public licen[sc]e(?: version)? (?:v ?)?2(?: 0)?|mpl 2 0 licen[sc]e"),
    ("mpl", "mpl", "mozilla public licen[sc]e"),
    ("epl-1", "epl 1 0", "eclipse public licen[sc]e(?: version)? (?:v ?)?1(?: 0)?"),
    ("epl-2", "epl 2 0", "eclipse public licen[sc]e(?: version)? (?:v ?)?2(?: 0)?"),
    ("edl-1", "edl 1 0", "eclipse distribution licen[sc]e"),
    ("cddl-1", "cddl 1 [01]", "common development and distribution licen[sc]e"),
    ("cpl-1", "cpl 1 0", "common public licen[sc]e"),
    ("ipl-1", "ipl 1 0", "ibm public licen[sc]e"),
    ("isc", "isc", "isc licen[sc]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng 2 0", "libpng licen[sc]e|png reference library licen[sc]e"),
    ("boost-1", "bsl 1 0", "boost software licen[sc]e"),
    ("busl-1.1", "busl 1 1", "business source licen[sc]e"),
    ("sspl-1", "sspl 1 0", "server side public licen[sc]e"),
    ("elastic-2", "elastic 2 0", "elastic licen[sc]e"),
    ("unlicense", "unlicense", "the unlicense|unlicense licen[sc]e"),
    ("wtfpl", "wtfpl", "wtfpl|do what the fuck you want to public licen[sc]e"),
    ("beerware", "beerware", "beer ?ware licen[sc]e"),
    ("cc0", "cc0 1 0", "cc0|cc zero|creative commons zero(?: licen[sc]e)?"),
    ("cc-by", "cc by [1234](?: [05])?", "cc by|creative commons attribution(?: licen[sc]e)?"),
    ("cc-by-sa", "cc by sa [1234](?: [05])?", "cc by sa|creative commons attribution share ?alike(?: licen[sc]e)?"),
    ("cc-by-nd", "cc by nd [1234](?: [05])?", "cc by nd|creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?"),
    ("cc-by-nc", "cc by nc [1234](?: [05])?", "cc by nc|creative commons attribution non ?commercial(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "cc by nc sa [1234](?: [05])?", "cc by nc sa|creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "cc by nc nd [1234](?: [05])?", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)?"),
    ("public-domain", "cc pddc", "in the public domain|dedicated to the public domain|public domain dedication"),
    ("artistic-1", "artistic 1 0", "artistic licen[sc]e(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic 2 0", "artistic licen[sc]e(?: version)? 2(?: 0)?"),
    ("psf-2", "psf 2 0|python 2 0", "python software foundation licen[sc]e|psf licen[sc]e"),
    ("php-3", "php 3 01?", "php licen[sc]e"),
    ("ruby", "ruby", "ruby licen[sc]e"),
    ("openssl", "openssl", "openssl licen[sc]e"),
    ("x11", "x11", "x11 licen[sc]e"),
    ("ms-pl", "ms pl", "microsoft public licen[sc]e"),
    ("ms-rl", "ms rl", "microsoft reciprocal licen[sc]e"),
    ("eupl", "eupl 1 [012]", "european union public licen[sc]e|eupl licen[sc]e"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font licen[sc]e"),
    ("odbl", "odbl 1 0", "open database licen[sc]e|open data commons open database licen[sc]e"),
    ("odc-by", "odc by 1 0", "open data commons attribution licen[sc]e"),
    ("ogl-3", "ogl uk 3 0", "open government licen[sc]e"),
    ("postgresql", "postgresql", "postgresql licen[sc]e"),
    ("unicode", "unicode(?: 3 0| dfs 2016)", "unicode licen[sc]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("ecl-2", "ecl 2 0", "educational community licen[sc]e"),
    ("afl-3", "afl 3 0", "academic free licen[sc]e"),
    ("osl-3", "osl 3 0", "open software licen[sc]e"),
    ("apsl-2", "apsl 2 0", "apple public source licen[sc]e"),
    ("cecill-2.1", "cecill 2 1", "cecill licen[sc]e"),
    ("vim", "vim", "vim licen[sc]e"),
    ("json", "json", "json licen[sc]e"),
    ("curl", "curl", "curl licen[sc]e"),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)? licen[sc]e"),
    ("upl-1", "upl 1 0", "universal permissive licen[sc]e"),
    ("openrail", "openrail", "(?:creativeml )?open ?rail(?: m)? licen[sc]e"),
    ("proprietary", "licenseref proprietary", "proprietary licen[sc]e"),
]
GRANT = ("(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?"
         "(?:{name})")
LINK = "(?:spdx|opensource|choosealicense|creativecommons) org licen[sc]es? (?:{tag})"
#: Kind, priority, confidence and pattern.
KINDS = [
    ("tag", 1, 1.0, "spdx licen[sc]e identifier (?:{tag})"),
    ("grant", 2, 0.95, GRANT),
    ("link", 3, 0.9, LINK),
    ("name", 4, 0.7, "(?:{name})"),
]
#: Words of which every match has at least one, and a look at a raw text that finds all of them.
KEY_WORD = r"^(?:un)?licen[cs].*|^[al]?gplv?[0-9]?$|^wtfpl$|^cc0?$|^domain$|^commons$"
KEY_TEXT = (rf"(?i)licen[cs]|gpl|wtfpl|commons|domain|(?<!{WORD[:-1]})cc0?(?!{WORD[:-1]})")


def rules() -> list[tuple[int, float, str, str, str]]:
    """Priority, confidence, label, key and pattern of all rules in order. The key is in every match of the pattern."""
    out = []
    for kind, priority, confidence, pattern in KINDS:
        for label, tag, name in LICENSES:
            if kind in ("tag", "link"):
                key = {"tag": " identifier ", "link": " org "}[kind]
            else:
                key = " under " if kind == "grant" else ""
            rx = rf"(?<= ){pattern.format(tag=tag, name=name)}(?= )"
            out.append((priority, confidence, label, key, rx))
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_table(found: list[tuple[int, float, str, str, str]]) -> Column:
    rows = [F.struct(F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(label).alias("label"),
                     F.lit(key).alias("key"), F.lit(rx).alias("rx")) for p, c, label, key, rx in found]
    return F.array(*rows)


def _stretch_labels(text: Column, key_at: Column, table: Column) -> Column:
    """The detections of a stretch that hold its key word and are not suppressed."""

    def matched(rule: Column) -> Column:
        parts = F.split(text, rule["rx"], -1)
        hits = F.regexp_extract_all(text, rule["rx"], F.lit(0))

        def place(hit: Column, i: Column) -> Column:
            start = (F.length(F.array_join(F.slice(parts, F.lit(1), i + 1), ""))
                     + F.when(i > 0, F.length(F.array_join(F.slice(hits, F.lit(1), i), ""))).otherwise(0))
            return F.struct(rule["priority"].alias("priority"), (-F.length(hit)).alias("neg_length"), start.alias("start"),
                            rule["label"].alias("label"), (start + F.length(hit)).alias("stop"),
                            rule["confidence"].alias("confidence"))

        return F.filter(F.transform(hits, place), lambda d: (d["start"] <= key_at) & (d["stop"] > key_at))

    likely = F.filter(table, lambda r: F.contains(text, r["key"]) & F.rlike(text, r["rx"]))
    found = F.flatten(F.transform(likely, matched))

    def first(e: Column, d: Column) -> Column:
        order = lambda x: F.struct(x["priority"], x["neg_length"], x["start"], x["label"])
        return (e["start"] <= d["start"]) & (e["stop"] >= d["stop"]) & (order(e) < order(d))

    # Lambdas of one expression must not capture each other's array: pair the array with each of its rows first.
    pairs = F.transform(found, lambda d: F.struct(d.alias("d"), found.alias("all")))
    kept = F.filter(pairs, lambda p: ~F.exists(p["all"], lambda e: first(e, p["d"])))
    return F.transform(kept, lambda p: F.struct(p["d"]["label"].alias("label"), p["d"]["confidence"].alias("confidence")))


def scan(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    phrase = f"(?:{'|'.join(BASE)})"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    df = df.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"),
                   F.when(F.rlike("text", F.lit(KEY_TEXT)), F.translate("text", UPPER, LOWER)).alias("likely"))
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace("likely", NO_WORD, " ")), F.lit(" "))
    df = df.select("doc_id", "n_words", plain.alias("plain"))
    base = F.coalesce(F.regexp_count("plain", F.lit(rf"(?<= ){phrase}(?= )")), F.lit(0)).cast("bigint")
    first = _spaces(F.regexp_extract("plain", rf"(?s)^(.*? ){phrase} ", 1)) - 1
    last = _spaces(F.regexp_extract("plain", rf"(?s)^(.* ){phrase} ", 1)) - 1
    base_labels = F.filter(F.array(*[F.when(F.contains("plain", F.lit(f" {p} ")), F.lit(v)) for p, v in BASE.items()]),
                           lambda x: x.isNotNull())
    words = F.split(F.trim("plain"), " ")
    keys = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.rlike(x["w"], F.lit(KEY_WORD)))
    df = df.select("doc_id", "n_words", base.alias("n_base"), F.when(base > 0, first).cast("bigint").alias("first_word"),
                   F.when(base > 0, last).cast("bigint").alias("last_word"), base_labels.alias("base"),
                   words.alias("words"), F.transform(keys, lambda x: x["i"]).alias("keys"))

    def stretch(i: Column) -> Column:
        low = F.greatest(i - REACH, F.lit(0))
        before = F.when(i > low, F.concat(F.array_join(F.slice("words", low + 1, i - low), " "), F.lit(" "))).otherwise("")
        return F.struct((F.length(before) + 1).alias("key_at"), F.concat(
            F.lit(" "), F.array_join(F.slice("words", low + 1, i - low + REACH + 1), " "), F.lit(" ")).alias("text"))

    df = df.withColumn("stretches", F.array_distinct(F.transform("keys", stretch))).drop("words", "keys")
    table = _rule_table(rules())
    found = F.flatten(F.transform("stretches", lambda s: _stretch_labels(s["text"], s["key_at"], table)))
    df = df.withColumn("found", F.coalesce(found, F.array().cast("array<struct<label:string,confidence:double>>")))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda x: x["label"]))))
    score = F.greatest(F.when(F.size("base") > 0, F.lit(0.95)).otherwise(F.lit(0.0)),
                       F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0)))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                     F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                     F.array_join(labels, ",").alias("labels"), score.alias("score"))
