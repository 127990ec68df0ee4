"""License scans: lines, whole texts and passages compared with license templates by Dice coefficient of word bigrams."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Well-known license notices, a license to several notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
THRESHOLD = 0.8

_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Texts of licenses and the notices that their authors ask for, whole.
WHOLE_TEXTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and '
        "limitations under the License.",
    ),
    "BSD-2-Clause": (_BSD_START + _BSD_END,),
    "BSD-3-Clause": (_BSD_START + _BSD_THIRD + _BSD_END,),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
}
#: What scan_passages() seeks: notices and whole texts.
PASSAGES = {name: TEMPLATES.get(name, ()) + WHOLE_TEXTS.get(name, ()) for name in sorted({*TEMPLATES, *WHOLE_TEXTS})}


def normalise(text: Column) -> Column:
    """Lower-case letters and digits, all else one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """The set of pairs of neighbouring words, space-joined; of a lone word the word itself."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda k: F.concat_ws(" ", F.get(words, k), F.get(words, k + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def _hashed(first: str, second: str) -> int:
    """XXH64 of two words as F.xxhash64() gives it: the second is hashed with the first one's hash as seed."""
    own = xxhash.xxh64_intdigest(second.encode(), xxhash.xxh64_intdigest(first.encode(), 42))
    return own - (1 << 64) if own >> 63 else own


def _plain(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, licenses (array of names in order), n_matches, best_dice, matches (array of structs line, license, dice).

    Compared are each line, and the whole text if it has several lines (line 0); both normalised. A coefficient 2 |A n B| / (|A| + |B|) of `threshold` or more needs |A| to be
    between t / (2 - t) and (2 - t) / t times |B|: lines of other sizes are dropped before any bigram is made, and then each line meets only the
    templates that its size allows. All of it happens in the scan, row by row: templates are literals of the plan, and nothing is exploded or shuffled.

    Null and empty texts match nothing and give an empty array, 0 and a best_dice of 0; repeated rows are scanned alike; ties of best are equal by value; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    known = [(name, _plain(t)) for name in sorted(templates) for t in templates[name]]
    low = [math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) for _, b in known]
    high = [math.floor(len(b) * (2 - threshold) / threshold + 1e-9) for _, b in known]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    # words are at least the distinct bigrams, so a line with fewer can match nothing; repeats may make a line longer than its set, by any number
    spans = F.concat(
        F.transform(lines, lambda line, k: F.struct((k + 1).alias("line"), line.alias("of"))),
        F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("line"), text.alias("of")))).otherwise(F.array().cast("array<struct<line:int,of:string>>")),
    )
    enough = F.filter(spans, lambda s: F.length(s["of"]) >= 3)
    cut = F.transform(enough, lambda s: F.struct(s["line"].alias("line"), F.split(normalise(s["of"]), " ").alias("words")))
    # a line has one distinct bigram fewer than words, or still fewer with repeats: of more than `high` + 1 words some must repeat
    sized = F.filter(cut, lambda s: (F.size(s["words"]) >= min(low, default=1)) & ((F.size(s["words"]) <= max(high, default=0) + 1) | (_distinct(s["words"]) <= max(high, default=0))))
    grams = F.transform(sized, lambda s: F.struct(s["line"].alias("line"), bigrams(s["words"]).alias("own")))

    def compared(s: Column) -> Column:
        n, out = F.size(s["own"]), []
        for (name, own), a, b in zip(known, low, high):
            shared = F.size(F.array_intersect(s["own"], F.array(*map(F.lit, own))))
            dice = F.when(n.between(a, b), 2.0 * shared / (n + len(own))).otherwise(F.lit(0.0))
            out.append(F.struct(s["line"].alias("line"), F.lit(name).alias("license"), dice.alias("dice")))
        return F.filter(F.array(*out), lambda m: m["dice"] >= threshold)

    found = F.array_sort(F.flatten(F.transform(grams, compared)))
    matches = docs.select(F.col(id_col).alias("_id"), found.alias("_found"))
    return matches.select(
        F.col("_id").alias(id_col),
        F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["license"]))).alias("licenses"),
        F.size("_found").cast("bigint").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("_found", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
        F.col("_found").alias("matches"),
    )


def _distinct(words: Column) -> Column:
    """A lower bound of the number of distinct bigrams: no text has fewer of them than distinct words less one."""
    return F.size(F.array_distinct(words)) - 1


def scan_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = PASSAGES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, licenses (array of names in order), n_passages, best_dice, passages (array of structs first, last, license, dice, in text order).

    Passages are runs of normalised words (first to last, counted from 1), wherever they stand: wrapped over lines or within a paragraph. A run is held against a template by the Dice
    coefficient of their sets of bigrams; runs have at least t / (2 - t) times the template's set and at most (2 - t) / t times all its bigrams. From each start the best end
    counts, of equal ones the nearest. Passages do not overlap: the highest coefficient goes first, then the longer run, the earlier one, the name; so of templates that are
    like one another only the best is reported for a passage.
    A changed text whose first lines are a notice unchanged gives two passages, of one license: the notice and the rest.

    The same bound prunes templates: one meets a text only if the text holds t / (2 - t) of the template's bigrams at all, and a start only if they follow it within the longest run.
    A run that starts or ends with a bigram foreign to the template is never better than without it, so only the template's own bigrams are starts and ends. From a start all ends are
    judged in one pass by running sums: a bigram is new in a run if the last one like it is before its start. Bigrams are compared by 64-bit hashes. It happens in the scan,
    row by row, without a shuffle. Null and empty texts give an empty array, 0 and 0; repeated rows are scanned alike; texts of any length are read whole; an empty table gives no rows;
    other columns are ignored. Templates need two words.
    """
    known = []
    for name in sorted(templates):
        for form in templates[name]:
            words = "".join(c if c.isalnum() else " " for c in form.lower()).split()
            own, n = sorted({_hashed(x, y) for x, y in zip(words, words[1:])}), len(words) - 1
            if n < 1:
                raise ValueError(f"a template of {name} has fewer than two words")
            known.append((name, own, max(1, math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)), math.floor(n * (2 - threshold) / threshold + 1e-9)))
    literal = [
        F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, own)).alias("grams"), F.lit(low).alias("low"), F.lit(high).alias("high")) for name, own, low, high in known
    ]
    vocabulary = F.array(*map(F.lit, sorted({g for _, own, _, _ in known for g in own})))
    kind = "array<struct<dice:double,length:int,first:int,license:string,last:int>>"
    none, no_numbers = F.array().cast(kind), F.array().cast("array<int>")

    def bound(x: Column, of: Callable[[Column], Column]) -> Column:
        """of(x) with x computed once: a filter on the result is pushed below projections and would repeat what they name."""
        return F.transform(F.array(x), of)[0]

    def pairs_of(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.xxhash64(F.get(words, k - 1), F.get(words, k)))
        return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<bigint>"))

    def before(pairs: Column) -> Column:
        """For each place the last one before it with the same bigram, or 0."""
        placed = F.array_sort(F.transform(pairs, lambda g, k: F.struct(g.alias("g"), (k + 1).alias("at"))))

        def told(own: Column) -> Column:
            last = lambda s, k: F.when((k > 0) & (F.get(own, k - 1)["g"] == s["g"]), F.get(own, k - 1)["at"]).otherwise(0)
            return F.transform(F.array_sort(F.transform(own, lambda s, k: F.struct(s["at"].alias("at"), last(s, k).alias("last")))), lambda s: s["last"])

        return bound(placed, told)

    def from_start(t: Column, hits: Column, i: Column) -> Column:
        """The best run that begins with the i-th hit (from 0). A bigram counts where its last one is before the start, so running sums tell how many different ones there are."""
        p, size = F.get(hits, i)["at"], F.size(t["grams"])

        def further(s: Column, h: Column) -> Column:
            shared = s["shared"] + (h["last"] < p).cast("int")
            foreign = s["foreign"] + F.when(h["at"] == p, 0).otherwise(F.size(F.filter(h["gap"], lambda v: v < p)))
            grown = F.struct(shared.alias("shared"), foreign.alias("foreign"))

            def judged(g: Column) -> Column:
                dice = 2.0 * g["shared"] / (g["shared"] + g["foreign"] + size)
                better = (h["at"] - p + 1 >= t["low"]) & (dice > s["dice"])
                return F.struct(g["shared"].alias("shared"), g["foreign"].alias("foreign"), F.when(better, dice).otherwise(s["dice"]).alias("dice"), F.when(better, h["at"]).otherwise(s["end"]).alias("end"))

            return F.when(h["at"] - p < t["high"], bound(grown, judged)).otherwise(s)

        begin = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("foreign"), F.lit(0.0).alias("dice"), F.lit(0).alias("end"))
        # the fields in the order in which passages are taken
        named = lambda b: F.struct((-b["dice"]).alias("dice"), (p - b["end"]).alias("length"), p.alias("first"), t["license"].alias("license"), (b["end"] + 1).alias("last"))
        return bound(F.aggregate(F.slice(hits, i + 1, t["high"]), begin, further), named)

    def of_template(pairs: Column, lasts: Column, places: Column, t: Column) -> Column:
        def hit(at: Column, k: Column, every: Column) -> Column:
            gap = at - F.coalesce(F.get(every, k - 1), F.lit(0)) - 1
            between = F.when((k > 0) & (gap > 0) & (gap < t["high"]), F.slice(lasts, at - gap, gap)).otherwise(no_numbers)
            return F.struct(at.alias("at"), F.get(lasts, at - 1).alias("last"), between.alias("gap"))

        def found(hits: Column) -> Column:
            # places ascend, so a start is followed by enough of them if the one `low` - 1 places on is near
            starts = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: F.get(hits, i + t["low"] - 1)["at"] - F.get(hits, i)["at"] < t["high"])
            return F.filter(F.transform(starts, lambda i: from_start(t, hits, i)), lambda m: m["dice"] <= -threshold)

        own = F.filter(places, lambda k: F.array_contains(t["grams"], F.get(pairs, k - 1)))
        return F.when(F.size(own) > 0, bound(bound(own, lambda every: F.transform(every, lambda at, k: hit(at, k, every))), found)).otherwise(none)

    def runs_of(pairs: Column) -> Column:
        def of_met(seen: Column) -> Column:
            met = F.filter(F.array(*literal), lambda t: F.size(F.array_intersect(seen, t["grams"])) >= t["low"])
            places = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda k: F.array_contains(seen, F.get(pairs, k - 1)))

            def all_of(ts: Column) -> Column:
                about = F.struct(before(pairs).alias("lasts"), places.alias("places"))
                runs = bound(about, lambda a: F.flatten(F.transform(ts, lambda t: of_template(pairs, a["lasts"], a["places"], t))))
                return F.when(F.size(ts) > 0, F.array_sort(runs)).otherwise(none)

            return bound(met, all_of)

        return bound(F.array_intersect(pairs, vocabulary), of_met).cast(kind)

    words = F.split(normalise(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), " ")
    runs = bound(bound(words, pairs_of), runs_of)
    free = lambda taken, m: ~F.exists(taken, lambda o: (o["first"] <= m["last"]) & (m["first"] <= o["last"]))
    taken = F.aggregate(runs, none, lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))
    found = F.array_sort(F.transform(taken, lambda m: F.struct(m["first"], m["last"], m["license"], (-m["dice"]).alias("dice"))))
    return docs.select(F.col(id_col).alias("_id"), found.alias("_found")).select(
        F.col("_id").alias(id_col),
        F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["license"]))).alias("licenses"),
        F.size("_found").cast("bigint").alias("n_passages"),
        F.coalesce(F.array_max(F.transform("_found", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
        F.col("_found").alias("passages"),
    )
