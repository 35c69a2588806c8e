"""Sharding, language ID and mixing against twins in plain Python, row by row."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.llm import language_id, mixing, sharding

M = (1 << 64) - 1


@pytest.fixture(scope="module")
def rows(planted):
    """The planted documents, some again under the same key, under none and with another text."""
    held = planted.select("doc_id", "text", "lang", "source")
    again = held.where("doc_id % 7 = 0")
    return held.unionByName(again).unionByName(again.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(again.withColumn("text", F.lit("other"))).withColumns({c: F.lit("clash") for c in ("size", "shard", "slot", "_row", "_block", "copies", "lang_pred", "score", "_p", "_at")}).cache()


# --- sharding


def _finalised(x, key):
    x = (x + key) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def _place(row, n):
    keys = [_finalised(i * 0x9E3779B97F4A7C15 & M, 0) for i in range(1, 9)]
    bits = 1
    while 1 << 2 * bits < n:
        bits += 1
    mask = (1 << bits) - 1
    while True:
        left, right = row >> bits, row & mask
        for k in keys:
            left, right = right, left ^ (_finalised(right, k) & mask)
        row = left << bits | right
        if row < n:
            return row


def test_every_row_has_the_place_of_its_number(rows):
    told = sorted(((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    want = Counter((d, s, c, i, _place(i, len(told)) % 16, _place(i, len(told)) // 16) for i, (d, c, s) in enumerate(told))
    assert Counter(map(tuple, sharding.shard_documents(rows, 16).select("doc_id", "size", "text_crc32", "row_number", "shard", "slot").collect())) == want


# --- language ID


def _trigrams(text):
    t = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    t = [32, *t, 32]
    out = Counter()
    for a, b, c in zip(t, t[1:], t[2:], strict=False):
        if b != 32:
            out[((((a * 0x1F123BB5 + b) & M) * 0x9E3779B97F4A7C15 & M) + c & M) * 0xD6E8FEB86659FD93 % (1 << 64) >> 48] += 1
    return out


def _mixture(grams, like, langs, total):
    share = dict.fromkeys(langs, 1 / len(langs))
    for _ in range(25):
        new = dict.fromkeys(langs, 0.0)
        for g, c in grams.items():
            s = sum(share[x] * like[x][g] for x in langs)
            for x in langs:
                new[x] += c * share[x] * like[x][g] / s / total
        moved = max(abs(new[x] - share[x]) for x in langs)
        share = new
        if moved <= 2e-3:
            break
    return share, sum(c * math.log(sum(share[x] * like[x][g] for x in langs)) for g, c in grams.items())


def test_languages_are_those_of_plain_python(rows):
    counts = defaultdict(Counter)
    held = rows.select("doc_id", "text", "lang").collect()
    for r in held:
        if r["lang"] and r["text"] is not None and zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(_trigrams(r["text"]))
    langs = sorted(counts)
    like = {x: defaultdict(lambda n=0.5 / (sum(counts[x].values()) + 32768): n, {g: (c + 0.5) / (sum(counts[x].values()) + 32768) for g, c in counts[x].items()}) for x in langs}
    found = {r["text"]: r for r in language_id.identify(rows.drop("lang", "source"), language_id.fit(rows)).collect()}
    checked = Counter()
    for text, r in found.items():
        if text is None or len(text) > 3000:
            continue
        grams = _trigrams(text)
        if not grams:
            assert (r["lang_pred"], r["score"], r["set_share"]) == ("und", 0.0, 0.0)
            continue
        n = sum(grams.values())
        cost = 3.0 * math.log(max(n, 2))
        share, _ = _mixture(grams, like, langs, n)
        order = sorted(langs, key=lambda x: (-share[x], x))
        alone = {x: sum(c * math.log(like[x][g]) for g, c in grams.items()) for x in langs}
        best = max(langs, key=lambda x: alone[x])
        value, chosen, lead, score = alone[best] - cost, [best], best, share[best]
        for k in range(2, len(langs) + 1):
            if share[order[k - 1]] <= 0.01:
                break
            own, ll = _mixture(grams, like, order[:k], n)
            if ll - k * cost <= value:
                break
            value, chosen, lead = ll - k * cost, order[:k], max(own, key=own.get)
            score = own[lead]
        assert (r["lang_pred"], r["lang_set"]) == (lead, ",".join(chosen)), text[:80]
        assert r["score"] == pytest.approx(score, abs=1e-4) and r["set_share"] == pytest.approx(sum(share[x] for x in chosen), abs=1e-4)
        checked[len(chosen)] += 1
    assert checked[1] > 50


def test_blocks_of_labels_answer_as_one_model(rows, monkeypatch):
    whole = language_id.fit(rows)
    asked = rows.select("doc_id", "text").where("length(text) < 5000").dropDuplicates(["text"])
    want = {r["text"]: (r["lang_pred"], r["lang_set"], round(r["score"], 6), round(r["set_share"], 6)) for r in language_id.identify(asked, whole).collect()}
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 2)
    blocks = language_id.fit(rows)
    assert isinstance(blocks, language_id.Blocks) and len(blocks.blocks) == -(-len(whole.langs) // 2) > 1
    got = {r["text"]: (r["lang_pred"], r["lang_set"], round(r["score"], 6), round(r["set_share"], 6)) for r in language_id.identify(asked, blocks).collect()}
    assert got == want


def test_a_thousand_labels_give_answers_and_the_driver_holds_a_block(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 300)
    held = []
    plain = language_id.Model.__init__
    monkeypatch.setattr(language_id.Model, "__init__", lambda self, langs, counts: (held.append(counts.shape), plain(self, langs, counts))[1])
    letters = [chr(c) for c in (*range(97, 123), *range(0xE0, 0xF6), *range(0x430, 0x450), *range(0x3B1, 0x3C9))]

    def sentence(i):
        r = random.Random(i)
        return " ".join("".join(r.choices(letters, k=8)) for _ in range(15))

    texts = [(i * 10 + j, sentence(i), f"l{i:04d}") for i in range(1000) for j in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert len(held) == 4 and max(n for n, _ in held) == 300 and len(model.langs) == len({t[2] for t in texts if zlib.crc32(str(t[0]).encode()) % 4 != 2})
    found = language_id.identify(df.where("doc_id % 100 = 0"), model).collect()
    assert len(found) == 100 and sum(r["lang_pred"] == r["lang"] for r in found) >= 90


def test_a_label_named_und_is_one_like_any_other(spark):
    df = spark.createDataFrame([(i, "abc", f"l{i % 9}") for i in range(99)], "doc_id long, text string, lang string")
    und = language_id.identify(df, language_id.fit(df.withColumn("lang", F.lit("und"))))
    assert {(r["lang_pred"], r["score"]) for r in und.collect()} == {("und", 1.0)}


# --- mixing


def test_copies_are_those_of_plain_python(rows):
    body = F.coalesce("text", F.lit(""))
    told = rows.select("doc_id", "source", F.size(F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("n"), F.xxhash64(F.lit(0), "doc_id", body).alias("h")).collect()
    by = defaultdict(list)
    for r in told:
        by[r["source"]].append((r["h"], r["doc_id"], r["n"]))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[2] for x in by[s]) for s in order]
    # targets by hand: what is above twice its size stops there, and the rest shares again
    weight, target, left = [(5, 2, 1)[i % 3] for i in range(len(order))], {}, 1.5 * sum(sizes)
    while True:
        open_ = [i for i in range(len(order)) if i not in target and sizes[i]]
        over = [i for i in open_ if left * weight[i] / sum(weight[j] for j in open_) >= 2 * sizes[i]]
        if not over:
            target.update({i: left * weight[i] / sum(weight[j] for j in open_) for i in open_})
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        left -= sum(2 * sizes[i] for i in over)
    want = Counter()
    for i, s in enumerate(order):
        full = min(2, int(target.get(i, 0) // sizes[i])) if sizes[i] else 0
        blocks = max(1, min(4096, len(by[s]) // 16))
        room = target.get(i, 0.0) - full * sizes[i]

        def taken(items, room, key):
            """Whole groups below the room, and what of the group at its edge goes."""
            groups = defaultdict(list)
            for x in items:
                groups[key(x)].append(x)
            for k in sorted(groups):
                n = sum(x[2] for x in groups[k])
                yield groups[k], room >= n, 0 < room < n, room
                room -= n

        for own, whole, edge, at in taken(by[s], room, lambda x: (x[0] >> 20) % blocks):
            if not edge:
                want.update((d, s, n, min(2, full + whole)) for _, d, n in own)
                continue
            for part, whole2, edge2, rest in taken(own, at, lambda x: x[0] & 4095):
                upto = 0
                for h, d, n in sorted(part, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
                    upto += n
                    want[d, s, n, min(2, full + (whole2 if not edge2 else upto - n / 2 <= rest))] += 1
    found = mixing.mix_plan(rows).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in found) == want
    assert {(r["source"], r["source_size"]) for r in found} == set(zip(order, sizes, strict=True))
    for r in found:
        assert r["target"] == pytest.approx(target.get(order.index(r["source"]), 0.0))
