"""Main text of pages by deducing each host's template from equivalence classes of tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tapewright.functions.durable import checkpoint
from tapewright.llm.common import salted_join

#: A class must be on so many pages, on this share of its host's pages, and have so many tokens.
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 3, 0.3, 3

#: A slot is boilerplate where less than this share of its text is outside of boilerplate elements.
MAIN_SHARE = 0.05

#: Template tokens of all hosts together that are broadcast at most.
MAX_BROADCAST_TOKENS = 2_000_000


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def _tokens(segments: list):
    """(hashes, starts): a hash of every token, its path with its place in the text and its word, and where segments start."""
    from itertools import chain

    import numpy as np
    from xxhash import xxh3_64_intdigest

    from tapewright.llm.shingles import mix

    sizes = np.fromiter((len(w) for _, w, _ in segments), np.int64, len(segments))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    word = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(w for _, w, _ in segments)), np.uint64, starts[-1])
    path = np.fromiter((p for p, _, _ in segments), np.uint64, len(segments))
    tag = np.fromiter((t for _, _, t in segments), bool, len(segments))
    place = np.arange(starts[-1]) - np.repeat(starts[:-1] + tag, sizes)
    return mix(mix(np.repeat(path, sizes) + place.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + word).view(np.int64), starts


def occurrence_classes(pages: DataFrame) -> DataFrame:
    """(host, tok, cls): tokens of large, frequent equivalence classes.

    A token's occurrence vector, its count on each page of the host, is known by its number of pages and
    two sums of hashes of (page, count); equal vectors have equal sums. Sums are added up in each batch
    and each task before they are shuffled, so a host with a third of all pages is no hot spot.
    """

    def count(batches: Iterable) -> Iterable:
        import numpy as np
        import pandas as pd
        from xxhash import xxh3_64_intdigest

        from tapewright.llm.html_parts import read
        from tapewright.llm.shingles import mix

        def summed(held: list, names: dict) -> pd.DataFrame:
            d = pd.DataFrame({c: np.concatenate(v) for c, v in zip(("code", "tok", "h"), zip(*held))})
            d["n"], d["s1"], d["s2"] = 1, d["h"] & 0x7FFFFFFF, d.pop("h").to_numpy().view(np.uint64) >> np.uint64(33)
            d["s2"] = d["s2"].astype(np.int64)
            out = d.groupby(["code", "tok"], sort=False, as_index=False).sum()
            out.insert(0, "host", np.array(list(names), object)[out.pop("code")])
            return out

        for b in batches:
            held, size, names = [], 0, {}
            for i, url, host, page in zip(b["id"], b["url"], b["host"], b["html"]):
                toks, times = np.unique(_tokens(read(page)[0])[0], return_counts=True)
                h = mix(np.uint64(xxh3_64_intdigest(f"{i}|{url}")) + mix(times.astype(np.uint64))).view(np.int64)
                held.append((np.full(len(toks), names.setdefault(host, len(names))), toks, h))
                size += len(toks)
                if size > 1_000_000:
                    yield summed(held, names)
                    held, size, names = [], 0, {}
            if size:
                yield summed(held, names)

    p = _pages(pages)
    sums = p.mapInPandas(count, "host string, tok long, n long, s1 long, s2 long").groupBy("host", "tok").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    hosts = p.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = salted_join(sums.filter(F.col("n") >= MIN_PAGES), hosts, ["host"], F.col("tok")).filter(F.col("n") >= MIN_SHARE * F.col("pages"))
    cls = F.xxhash64("n", "s1", "s2")
    sized = frequent.select("host", "tok", cls.alias("cls")).groupBy("host", "cls").agg(F.collect_list("tok").alias("toks")).filter(F.size("toks") >= MIN_TOKENS)
    return sized.select("host", F.explode("toks").alias("tok"), "cls")


def _with_template(pages: DataFrame, template: DataFrame) -> DataFrame:
    """Pages with `toks` and `cls` of their host: broadcast after a look at the number of tokens, else a salted join.

    A host's tokens are at most its mean page length over MIN_SHARE.
    """
    per = template.groupBy("host").agg(F.collect_list(F.struct("tok", "cls")).alias("t")).select("host", "t.tok", "t.cls").withColumnsRenamed({"tok": "toks"})
    if template.count() <= MAX_BROADCAST_TOKENS:
        return pages.join(F.broadcast(per), "host", "left")
    return salted_join(pages, per, ["host"], F.struct("id", "url"), "left")


def deduce_template(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template, shut): (host, tok, cls) of the valid classes of every host, and (host, slot) of its boilerplate slots.

    cls is 0 for the root, the class that the others are nested in: the one with most tokens among those
    once on a page; else 1. A class is valid if its tokens come in the same order, again and again, on all
    pages. Slots are the gaps after the root's tags; one is boilerplate where hardly any of its text, over
    all pages of the host, is outside of navigation, notices, adverts, forms, comments and the like.
    """

    def look(batches: Iterable) -> Iterable:
        import numpy as np
        import pandas as pd
        from xxhash import xxh3_64_intdigest

        from tapewright.llm.html_parts import read

        maps = HostMaps()
        for b in batches:
            orders, texts = [], []
            for host, page, toks, cls in zip(b["host"], b["html"], b["toks"], b["cls"]):
                if toks is None:
                    continue
                segments, blocks = read(page)
                hashes, starts = _tokens(segments)
                of, known = maps(host, toks, cls)(hashes)
                hashes, of = hashes[known], of[known]
                for c in np.unique(of):
                    seq = hashes[of == c]
                    size = len(np.unique(seq))
                    times = len(seq) // size
                    fine = times * size == len(seq) and (seq.reshape(times, size) == seq[:size]).all() and len(np.unique(seq[:size])) == size
                    orders.append((host, c, xxh3_64_intdigest(seq[:size].tobytes()) >> 1 if fine else -1, size, times))
                    at, slots = _tag_places(segments, starts, known, of == c, hashes)
                    for text, boiler, _, _, end in blocks:
                        k = int(np.searchsorted(at, end)) - 1
                        texts.append((host, c, slots[k] if k >= 0 else 0, len(text), 0 if boiler else len(text)))
            one = pd.DataFrame(orders, columns=["host", "cls", "lo", "size", "times"])
            one["hi"] = one["lo"]
            one = one.groupby(["host", "cls"], as_index=False).agg({"lo": "min", "hi": "max", "size": "max", "times": "max"})
            two = pd.DataFrame(texts, columns=["host", "cls", "slot", "chars", "free"]).groupby(["host", "cls", "slot"], as_index=False).sum()
            both = pd.concat([one, two])
            if len(both):
                yield both[[c for c, _ in kinds]].astype({c: "Int64" for c, k in kinds if k == "long"})

    kinds = [("host", "string"), *((c, "long") for c in ("cls", "lo", "hi", "size", "times", "slot", "chars", "free"))]
    classes = checkpoint(occurrence_classes(pages))
    seen = _with_template(_pages(pages), classes).select("host", "html", "toks", "cls").mapInPandas(look, ", ".join(f"{c} {k}" for c, k in kinds))
    seen = checkpoint(
        seen.groupBy("host", "cls", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"), F.max("times").alias("times"), F.sum("chars").alias("chars"), F.sum("free").alias("free"))
    )
    valid = seen.filter(F.col("slot").isNull() & (F.col("lo") == F.col("hi")) & (F.col("lo") >= 0)).select("host", "cls", "size", "times")
    roots = valid.filter(F.col("times") == 1).groupBy("host").agg(F.max(F.struct("size", "cls")).alias("r")).select("host", F.col("r.cls").alias("root"))
    marked = valid.join(roots, "host").select("host", "cls", F.when(F.col("cls") == F.col("root"), 0).otherwise(1).cast("long").alias("kind"))
    template = checkpoint(classes.join(marked, ["host", "cls"]).select("host", "tok", F.col("kind").alias("cls")))
    slots = seen.filter(F.col("slot").isNotNull()).join(roots, "host").filter(F.col("cls") == F.col("root"))
    return template, checkpoint(slots.filter(F.col("free") < MAIN_SHARE * F.col("chars")).select("host", "slot"))


def _tag_places(segments: list, starts, known, own, hashes):
    """(segment, hash) of the tags among the tokens of a class; the end of the segment stands for its place."""
    import numpy as np

    at = np.searchsorted(starts, np.nonzero(known)[0][own], side="right") - 1
    tag = np.fromiter((segments[k][2] for k in at), bool, len(at))
    return at[tag], hashes[own][tag].tolist()


class HostMaps:
    """For each host a look-up of token hashes in its template; at most 1,000 hosts are kept at a time."""

    def __init__(self) -> None:
        self.maps: dict = {}

    def __call__(self, host: str, toks, cls):
        import numpy as np

        got = self.maps.get(host)
        if got is None:
            if len(self.maps) >= 1000:
                self.maps.clear()
            order = np.argsort(toks)
            got = self.maps[host] = (toks[order], cls[order])
        toks, cls = got

        def find(hashes):
            """(class of each, whether it has one)"""
            k = np.minimum(np.searchsorted(toks, hashes), len(toks) - 1)
            return cls[k], toks[k] == hashes

        return find


def _slots(page: str, find) -> list[tuple[int, str, bool, bool, bool]]:
    """(slot, text, boiler, main, constant) of a page's blocks; a slot is named by the root tag before it."""
    import numpy as np

    from tapewright.llm.html_parts import read

    segments, blocks = read(page)
    if find is None:
        return [(0, text, boiler, main, False) for text, boiler, main, _, _ in blocks]
    if any(main and not boiler for _, boiler, main, _, _ in blocks):  # constant words do not matter then
        segments = [(p, w if tag else [], tag) for p, w, tag in segments]
    hashes, starts = _tokens(segments)
    of, known = find(hashes)
    places = np.nonzero(known)[0]
    at, slots = _tag_places(segments, starts, known, of[places] == 0, hashes[places])
    out = []
    for text, boiler, main, first, end in blocks:
        k = int(np.searchsorted(at, end)) - 1
        words = [s for s in range(first, end) if not segments[s][2]]
        out.append((slots[k] if k >= 0 else 0, text, boiler, main, all(known[starts[s] : starts[s + 1]].all() for s in words)))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) of every page: the main text, and how many template tokens its host has.

    The gaps of the host's template are its slots. A slot is left out if hardly any of its text, over all
    pages of the host, is outside of navigation, notices, adverts, forms, comments and the like. From
    the others the page's blocks are taken in order, without blocks inside such elements. If the page
    has an article or main element, only its blocks count; elsewhere blocks of template words alone go
    too. A host with too few pages for a template is read by its elements only.

    Null or empty html, or none but markup, gives an empty text. A null url is a host of its own name.
    Repeated rows each get their text; they count as one page more in the vectors.
    """

    def take(batches: Iterable) -> Iterable:
        import pandas as pd

        maps = HostMaps()
        for b in batches:
            texts, sizes = [], []
            for host, page, toks, cls, shut in zip(b["host"], b["html"], b["toks"], b["cls"], b["shut"]):
                closed = set(shut.tolist()) if shut is not None else set()
                blocks = _slots(page, maps(host, toks, cls) if toks is not None else None)
                has_main = any(main for _, _, boiler, main, _ in blocks if not boiler)
                texts.append("\n\n".join(t for s, t, boiler, main, constant in blocks if not boiler and s not in closed and (main if has_main else not constant)))
                sizes.append(0 if toks is None else len(toks))
            yield pd.DataFrame({"page_id": b["id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_template": sizes})

    template, closed = deduce_template(pages)
    p = _with_template(_pages(pages), template)
    # A host's slots are some of its root tokens, so they follow the template: broadcast or salted with it.
    per_host = closed.groupBy("host").agg(F.collect_list("slot").alias("shut"))
    if closed.count() <= MAX_BROADCAST_TOKENS:
        with_shut = p.join(F.broadcast(per_host), "host", "left")
    else:
        with_shut = salted_join(p, per_host, ["host"], F.struct("id", "url"), "left")
    kind = dict(pages.dtypes)["page_id"]
    return with_shut.select("id", "url", "host", "html", "toks", "cls", "shut").mapInPandas(take, f"page_id {kind}, url string, text string, n_chars long, n_template long")
