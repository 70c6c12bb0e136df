"""Personal data in whole texts: four kinds by pattern, others by a conditional random field.

Base kinds are leftmost non-overlapping matches of fixed patterns; a match that fails its check is dropped. The field (see
``crf``) labels the words of each line by their shapes and neighbours and adds names, addresses, national telephone numbers,
numbers of persons and accounts, dates of birth and mail addresses that are spelled out. It is trained from ``LABELLED``, a
small table of lines, each filled in ``variants`` times with made-up values. A span of the field that meets a base span is
left out; base spans always stay.

Defined results: null text is empty; an empty text has no spans; rows of equal or null doc_id each get a result; an empty
table gives an empty result. Spans count code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.llm.common import without_clash
from quarrystat.llm.crf import EDGES, OUTSIDE, Crf, train
from quarrystat.llm.texthash import space_table, trim

#: The base kinds in their order, and what their patterns look for. Runs of digits are entered at their start only
#: and mail addresses from their @ on, which finds the same matches in time that grows with the text.
BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds of the field, in the order in which they follow the base kinds.
FOUND = ("name", "address", "tel", "number", "birth", "mail")
KINDS = (*BASE, *FOUND)

#: What spans of some kinds must hold, as base kinds have their checks.
SIGNS = {"mail": re.compile(r"(?i)\bat\b.+\bdot\b"), "address": re.compile("[0-9]"), "tel": re.compile("[0-9]"), "number": re.compile("[0-9]"), "birth": re.compile("[0-9]")}

#: Labelled lines: {kind} stands for a finding, <kind> for a look-alike that is none.
LABELLED = """\
My name is {name} and I live in {address}.
Hello, I am {name}, call me at {tel} please.
Please contact {name} at {tel} for details.
Contact: {name}, {address}
Name: {name}
Full name: {name} Date of birth: {birth}
Name: {name}, born {birth}, SSN {number}
Patient: {name} DOB: {birth}
Dear {name}, thank you for your letter.
Dear Mr. {name}, your account number is {number}.
Mr. {name} lives at {address}.
Mrs. {name} was born on {birth} and moved to {address}.
Dr. {name} can be reached by phone at {tel}.
Signed by {name} on <date>
Customer: {name}, phone {tel}
Her SSN is {number} and she was born on {birth}.
Social security number: {number}
passport no. {number} issued to {name}
Account number: {number}
IBAN: {number}
Please pay to IBAN {number} by <date>.
tax id {number}
Tel: {tel}
Phone: {tel}, fax: {tel}
call {tel} or write to {mail}
Mobile: {tel}
write me at {mail} any time
My mail is {mail} thanks
e-mail: {mail}
Address: {address}
Ship to {name}, {address}
They live at {address} since <date>.
Born: {birth}
date of birth {birth}
Regards, {name}
Kind regards {name}
Mein Name ist {name} und ich wohne in der {address}.
Herr {name} ist unter Telefon {tel} erreichbar.
Frau {name}, geboren am {birth}, wohnt {address}.
Sehr geehrte Frau {name}, vielen Dank.
Geburtsdatum: {birth}
Adresse: {address}
Steuernummer {number}
Telefon: {tel}
Je m'appelle {name} et je suis né le {birth}.
Monsieur {name} habite {address}.
Madame {name}, téléphone {tel}
Nom: {name}
Adresse: {address} Téléphone: {tel}
né le {birth}
numéro de sécurité sociale {number}
Me llamo {name} y nací el {birth}.
Señor {name} vive en {address}.
Señora {name}, teléfono {tel}
Nombre: {name}
Dirección: {address}
fecha de nacimiento {birth}
número de cuenta {number}
The meeting is on <date> in room <small>.
Version <version> was released on <date>.
Order <code> shipped with <small> items for <money>.
Please see section <version> of the report.
The House of <Place> was built in <year> near the river.
In <year> the Company sold <small> units in <Place>.
<Place> is a city in the north, and the name is old.
Chapter <small>: The Return
It rained in <Place> and the Old Town was empty.
Error <code> at line <small> of the file.
The total is <money> for <small> people.
Licensed under CC BY-NC <version>.
Licensed under the GNU General Public License, version <small>
the Free Software Foundation and the Apache Software Foundation
Copyright (c) <year> The Authors. All Rights Reserved.
we meet at noon on the dot at the mall
look at that at once and dot the line
See RFC <small> and ISO <small> for the format.
On Monday The Times wrote that prices fell <small> percent.
Call the function with <small> arguments.
The address of the object is <code> in memory.
The phone has <small> keys and a screen of <small> inches.
Name the file <code> and run it again.
My dear friend, this is the end of the story.
Die Stadt <Place> wurde <year> gegründet.
Der Name der Datei ist <code> und Version <version>.
La ville de <Place> est belle en <year>.
El número de la página es <small>.
La dirección del viento cambia en <Place>.
A contact lens costs <money> here.
Table <small> shows <small> rows, <small> columns and <money>.
born to run, built to last
He was born in <Place> in <year>.
They call it home since <year>.
password = "<code>" and token = "<code>"
id = <code> key: <code>
<small> <small> <small> <small>
<code> <code> <small>
The Quick Brown Fox Jumps. Over <small> Lazy Dogs.
Thanthe wor erin. Isthe <small> ofer, Andin the thor!
Enla parque souè. Le éren douleau <small> que Lareau.
Derein ung chauf. Von Geber <small> und erzu Lichen.
Word | Word | <small> | Other | Words
Alpha!! Beta!! <code>!! Gamma!! <small>!!
"""

#: Made-up values of findings and look-alikes.
FIRST = "Anna John Maria Peter Jean Luis Carla Henrik Sofie Tom Elena Marc Julia Ahmed Yuki Nora Paul Inês Zoë André".split()
LAST = "Miller Schmidt Dubois García Novak Olsen Rossi Brown Keller Moreau López Weiß O'Neil Tanaka Khan Svensson Meyer-Lund Petit Costa Huber".split()
STREET = "Main Oak Park Hill Church Station Garden River Mill Queen".split()
PLACES = "Berlin Springfield Paris Toledo Lyon Hamburg Boston Sevilla Dresden Nantes".split()
MONTHS = "January February March April May June July August September October November December".split()


def _value(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
    first, last, place, street = r.choice(FIRST), r.choice(LAST), r.choice(PLACES), r.choice(STREET)
    day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1940, 2024)
    low = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    ways = {
        "name": [f"{first} {last}", f"{first} {last}", f"{first} {up(1)}. {last}", f"{first} {r.choice(LAST)} {last}", last],
        "address": [
            f"{d(2)} {street} {r.choice(['Street', 'Avenue', 'Road', 'Lane'])}, {place}", f"{d(3)} {street} St, {place} {d(5)}", f"{street}straße {d(2)}, {d(5)} {place}",
            f"{d(2)} rue de {place}, {d(5)} {r.choice(PLACES)}", f"Calle {street} {d(2)}, {d(5)} {place}", f"{street}weg {d(1)}, {d(5)} {place}",
        ],
        "tel": [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(7)}", f"0{d(3)}/{d(6)}", f"{d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}"],
        "number": [f"{d(3)}-{d(2)}-{d(4)}", f"{up(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"{up(1)}{d(8)}", d(9), f"{d(2)}/{d(3)}/{d(5)}", f"{up(2)}{d(7)}"],
        "birth": [f"{day:02}/{month:02}/{year}", f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{MONTHS[month - 1]} {day}, {year}", f"{day} {MONTHS[month - 1]} {year}"],
        "mail": [f"{first.lower()} at {last.lower()} dot com", f"{first.lower()}.{last.lower()} (at) mail dot org", f"{first.lower()} [at] {place.lower()} [dot] net", f"{first.lower()}{d(2)} at mail dot example dot com"],
        "date": [f"{day:02}/{month:02}/{year}", f"{year}-{month:02}-{day:02}", f"{MONTHS[month - 1]} {day}, {year}", f"{day} {MONTHS[month - 1]} {year}", f"{day}.{month}.{year}"],
        "small": [d(1), d(2), d(3), d(4), f"{d(1)}.{d(2)}"],
        "year": [str(year)],
        "version": [f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(2)}.{d(1)}"],
        "money": [f"${d(2)}.{d(2)}", f"{d(3)},{d(2)} EUR", f"{d(1)},{d(3)} dollars"],
        "code": [f"{up(2)}-{d(4)}", low(16), f"0x{d(6)}", d(16), f"{low(6)}.txt", f"{low(8)}-{low(4)}", f"{up(4)}{d(12)}", d(8)],
        "Place": [place, f"{place} {r.choice(PLACES)}", street],
    }
    return r.choice(ways[kind])


@dataclass(frozen=True)
class Finder:
    variants: int = 4
    #: Lines of prose without a finding, of made-up words.
    prose: int = 400
    seed: int = 11
    steps: int = 150
    #: The labelled table is read by the driver; more rows than this are an error.
    most_lines: int = 10_000
    batch_bytes: int = 4_000_000


#: Short words of made-up prose, among them those that spelled mail addresses and dates share with it.
SMALL = "the of and at to in for on is my was it by as he name that with this der die und in von zu den am ist geboren le la de et les un par est el en y que se los del vive".split()


def _prose(r: random.Random) -> list[tuple[str, str]]:
    """A line of made-up words: sentences, one-word sentences, capitals, marks behind words."""
    part = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéèöüñí") for _ in range(r.randint(1, 3))) + r.choice(["", "n", "s", "r", "t"])
    mark = r.choice(["", "", "", "", "!!", "###", "***", "&&&", "%%%", "$$$", " |"])
    if r.random() < 0.15:  # one word many times
        w = r.choice([str.capitalize, str.upper, str.lower])(r.choice([part(), r.choice(SMALL)])) + r.choice(["", "", ",", ".", ":", mark])
        return [(x, OUTSIDE) for x in f"{part()} {' '.join([w] * r.choice([3, 8, 16]))} {part()}".split(" ")]
    upper, out, new = r.random() < 0.1, [], r.random() < 0.7
    for _ in range(r.choice([1, 2, 4, 8, 12, 14])):
        w = r.choice(SMALL) if r.random() < 0.35 else part()
        w = w.upper() if upper else w.capitalize() if new or r.random() < 0.04 else w
        end = r.choices(["", ",", ".", ":", "?", "!"], [16, 2, 3 if not new else 6, 0.4, 0.3, 0.3])[0]
        new = end not in ("", ",", ":")
        out += [(x, OUTSIDE) for x in f"{w}{end}{mark}".split(" ")]
        if r.random() < 0.02:
            out.append((_value(r.choice(["small", "code", "version", "year"]), r), OUTSIDE))
    return out


def labelled_lines(cfg: Finder = Finder()) -> list[list[tuple[str, str]]]:
    """The table's lines, filled in, as words with labels."""
    r = random.Random(cfg.seed)
    out = []
    for text in LABELLED.splitlines() * cfg.variants:
        line: list[tuple[str, str]] = []
        for part in text.split(" "):
            spot = re.search(r"[{<](\w+)[}>]", part)
            if not spot:
                line.append((part, OUTSIDE))
                continue
            label = spot[1] if spot[0][0] == "{" else OUTSIDE
            words = (part[: spot.start()] + _value(spot[1], r) + part[spot.end() :]).split(" ")
            line += [(w, label) for w in words]
        out.append(line)
    return out + [_prose(r) for _ in range(cfg.prose)]


def labelled_table(spark: SparkSession, cfg: Finder = Finder()) -> DataFrame:
    """The labelled lines as a table (line, words, labels), the form that ``fit`` takes."""
    rows = [(i, [w for w, _ in line], [x for _, x in line]) for i, line in enumerate(labelled_lines(cfg))]
    return spark.createDataFrame(rows, "line long, words array<string>, labels array<string>")


def fit(labelled: DataFrame, cfg: Finder = Finder()) -> Crf:
    """The field of a labelled table (words, labels)."""
    rows = labelled.select("words", "labels").limit(cfg.most_lines + 1).collect()
    if len(rows) > cfg.most_lines:
        raise ValueError(f"more than {cfg.most_lines} labelled lines")
    lines = sorted(list(zip(r["words"], r["labels"])) for r in rows if r["words"])
    return train(lines, (OUTSIDE, *FOUND), steps=cfg.steps)


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base kinds, sorted."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    base, size = int(off[0]), int(off[-1] - off[0])
    return np.frombuffer(data, dtype=np.uint8)[base : base + size] if size else np.zeros(0, dtype=np.uint8), off - base


def _labelled(raw: np.ndarray, off: np.ndarray, field: Crf) -> list[tuple[int, int, int, int]]:
    """(text, first byte, end byte, number of the kind) of the field's spans; bytes count from the text's start."""
    word = space_table()[raw]
    edge = np.empty(len(raw), dtype=bool)
    edge[:1] = True
    edge[1:] = word[1:] != word[:-1]
    edge[off[:-1][np.diff(off) > 0]] = True
    begin = np.flatnonzero(edge)
    if not len(begin):
        return []
    ends = np.append(begin[1:], len(raw))
    mine = word[begin]
    cut = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = cut.dictionary_encode()
    code, starts, stops = coded.indices.to_numpy()[mine], begin[mine], ends[mine]
    if not len(starts):
        return []
    doc = np.searchsorted(off, starts, "right") - 1
    lines = np.searchsorted(np.flatnonzero(raw == 0x0A), starts)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1])
    label = field.decode(field.scores(coded.dictionary, code, first), first)
    at = np.flatnonzero(label)
    if not len(at):
        return []
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (label[at[1:]] != label[at[:-1]]) | first[at[1:]]
    lo = at[new]
    hi = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    for i in np.flatnonzero(np.isin(label[lo], [1 + FOUND.index(k) for k in SIGNS])).tolist():
        if not SIGNS[FOUND[label[lo[i]] - 1]].search(raw[starts[lo[i]] : stops[hi[i]]].tobytes().decode()):
            label[lo[i]] = 0
    lo, hi = lo[label[lo] > 0], hi[label[lo] > 0]
    return list(zip(doc[lo].tolist(), (starts[lo] - off[doc[lo]]).tolist(), (stops[hi] - off[doc[lo]]).tolist(), (label[lo] + len(BASE) - 1).tolist()))


def _run(cfg: Finder, field: Crf, name: str = "spans"):
    def spans(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        texts = pc.fill_null(texts, "")
        raw, off = _text_arrays(texts)
        # texts with a digit or @
        some = np.diff(np.searchsorted(np.flatnonzero(((raw >= 0x30) & (raw <= 0x39)) | (raw == 0x40)), off)) > 0
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        known: dict[int, str] = {}
        text = lambda d: known.setdefault(d, texts[d].as_py())
        for d in np.flatnonzero(some).tolist():
            out[d] = base_spans(text(d))
        for d, lo, hi, kind in _labelled(raw, off, field):
            whole = raw[off[d] : off[d + 1]]
            start = int(np.count_nonzero((whole[:lo] & 0xC0) != 0x80))
            shown = whole[lo:hi].tobytes().decode()
            start += len(shown) - len(shown.lstrip(EDGES))
            shown = shown.strip(EDGES)
            end = start + len(shown)
            if shown and not any(s < end and start < e for s, k, e in out[d] if k < len(BASE)):
                out[d].append((start, kind, end))
        return [sorted(x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array(KINDS)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(sizes):
                # about batch_bytes of text; a longer text stands alone
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + cfg.batch_bytes, "right")))
                found = spans(texts.slice(lo, hi - lo))
                flat = [x for f in found for x in f]
                ints = lambda i: pa.array([x[i] for x in flat], pa.int32())
                structs = pa.StructArray.from_arrays([kinds.take(ints(1)), ints(0), ints(2)], ["kind", "start", "end"])
                at = pa.array(np.append(0, np.cumsum(list(map(len, found)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], pa.ListArray.from_arrays(at, structs)], [*batch.schema.names, name])
                lo = hi
        trim()

    return run


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, field: Crf, cfg: Finder = Finder()) -> tuple[DataFrame, str]:
    """The documents' columns with ``{prefix}spans``, sorted by start and kind."""
    p = without_clash(docs)
    plain = docs.withColumn(f"{p}text", F.col("text").cast("string"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = plain.mapInArrow(_run(cfg, field, f"{p}spans"), f"{names}, `{p}spans` {SPANS}")
    return out.drop(f"{p}text"), p


def redact(docs: DataFrame, field: Crf, cfg: Finder = Finder()) -> DataFrame:
    """The documents with each span's text replaced by its kind in brackets; of overlapping spans the first decides."""
    out, p = find(docs, field, cfg)
    text, spans = F.col("text"), F.col(f"{p}spans")
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["s"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        new = x["start"] >= acc["at"]
        return F.struct(F.when(new, put).otherwise(acc["s"]).alias("s"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["s"], F.substring(text, a["at"] + 1, F.length(text))))
    return out.select(*[F.when(F.size(spans) > 0, done).otherwise(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, cfg: Finder = Finder()) -> DataFrame:
    """The operator's contract."""
    field = fit(labelled_table(docs.sparkSession, cfg), cfg)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, p = find(plain, field, cfg)
    spans = F.col(f"{p}spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"))
