import hashlib
import random
import zlib

import numpy as np
import pytest

from siltstone.llm import fingerprints, licenses, mixing, packing, shards, tokens, transport
from tests.llm.cases import LONG, awkward, empty, words

SCHEMA = "doc_id long, text string, source string"


# mixing


def plain_targets(sizes, weights, most=3.0):
    """Shares by weight; a share above its bound is cut to it, and what is over dealt again."""
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n], float(sum(sizes))
    while open_:
        weight = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / weight for i in open_}
        full = [i for i in open_ if share[i] >= most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else share[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def found_targets(spark, sizes, weights=(5, 2, 1)):
    rows = spark.createDataFrame([(f"s{i:04}", n, 1) for i, n in enumerate(sizes)], "_source string, source_size long, rows long")
    return [r.target for r in sorted(mixing.with_targets(rows, weights).collect(), key=lambda r: r._s)]


def test_targets_share_by_weight_and_stop_at_three_times(spark):
    assert found_targets(spark, [100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    got = found_targets(spark, [10, 1000, 1000])
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert found_targets(spark, [0, 10]) == [0, 10]
    assert found_targets(spark, []) == []
    draw = random.Random(5)
    for n in (7, 40):
        sizes = [int(draw.paretovariate(0.6) * 10) for _ in range(n)]
        assert found_targets(spark, sizes) == pytest.approx(plain_targets(sizes, (5, 2, 1)))


def test_sources_are_in_order_of_code_points(spark):
    names = ["b", None, "\U0001f600", "\uffff", "a", "Z", ""]
    rows = spark.createDataFrame([(n, 1, 1) for n in names], "_source string, source_size long, rows long")
    got = [r._source for r in sorted(mixing.with_targets(rows, (5, 2, 1)).collect(), key=lambda r: r._s)]
    assert got == ["", "Z", "a", "b", "\uffff", "\U0001f600", None]


def test_a_row_repeated_beyond_a_run_is_dealt_out(spark, monkeypatch):
    from siltstone.llm import common

    monkeypatch.setattr(common, "COPIES", 7)
    df = spark.createDataFrame([(1, "a b c", "s")] * 100 + [(2, "d e", "t")] * 3, SCHEMA)
    rows = common.numbered_copies(df).collect()
    assert sorted(r._row for r in rows if r.doc_id == 1) == list(range(1, 101)) and len(rows) == 103
    k = [c for c in common.row_key(df)]
    decisions = df.select(*k).distinct().selectExpr("_k1", "_k2", "if(_k1 = first_value(_k1) over (order by _k1), 30, 2) as copies")
    assert sorted(r[1] for r in common.take_copies(df, decisions).groupBy("doc_id").count().collect()) == [2, 30]


def test_rows_that_differ_in_a_map_or_a_null_stay_apart(spark):
    from siltstone.llm.common import row_key, take_copies

    rows = [(1, {"a": 1, "b": 2}, None, "x"), (1, {"b": 2, "a": 1}, None, "x"), (1, {"a": 2}, None, "x"), (1, None, None, "x"), (1, None, "x", None), (1, {}, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, m map<string,int>, p string, q string")
    nested = df.selectExpr("*", "array(named_struct('k', m)) n")
    for frame in (df, nested):
        keys = frame.select(*row_key(frame)).collect()
        assert keys[0] == keys[1] and len(set(keys)) == 5
        one = take_copies(frame, frame.select(*row_key(frame)).distinct().selectExpr("*", "1 as copies"))
        assert one.columns == frame.columns and one.count() == 5 and one.filter("m['a'] = 2").count() == 1


def test_flight_keeps_both_totals_and_leaves_two():
    draw = random.Random(3)
    size = [draw.randrange(1, 500) for _ in range(300)]
    prob = [0.37] * 300
    held = mixing.flight(prob, size, draw)
    assert len(held) <= 2 and all(p in (0.0, 1.0) for i, p in enumerate(prob) if i not in held)
    assert sum(prob) == pytest.approx(0.37 * 300)
    assert sum(p * s for p, s in zip(prob, size, strict=True)) == pytest.approx(0.37 * sum(size))


def test_flight_keeps_expectations():
    size, n = [1, 5, 9, 13, 2, 7], 4000
    hits = np.zeros(6)
    for k in range(n):
        prob = [0.5, 0.3, 0.2, 0.6, 0.8, 0.4]
        mixing.flight(prob, size, random.Random(k))
        hits += prob
    assert np.abs(hits / n - [0.5, 0.3, 0.2, 0.6, 0.8, 0.4]).max() < 0.03


def test_mix_meets_targets_over_many_blocks(spark):
    rows = [(i, "a " * (1 + i * 7 % 90), f"s{min(i % 9, 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block_rows=50).toPandas()
    assert len(got) == 3000 and got.doc_id.is_unique and (got.taken <= 3 * got["size"]).all()
    by = got.merge(df.select("doc_id", "source").toPandas()).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() / by.target < 0.01).all()
    again = mixing.mix(df.repartition(3), block_rows=50).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mix_awkward_and_empty(spark):
    got = mixing.mix(awkward(spark)).toPandas()
    assert len(got) == 13 and got["size"].min() == 0 and got.taken.notna().all()
    assert mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed(awkward(spark))
    assert mixed.columns == awkward(spark).columns and mixed.count() == got.copies.sum()


def test_mix_of_one_row_repeated(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 200 + [(2, "d e f", "t")] * 100, SCHEMA)
    got = mixing.mix(df, block_rows=20).groupBy("doc_id").sum("taken").collect()
    assert dict(got)[1] == pytest.approx(900 * 5 / 7, abs=3)


# tokens


def test_segment_tree_finds_the_least_room():
    draw, tree, held = random.Random(1), tokens.Rooms(100), []
    for _ in range(2000):
        wanted = draw.randrange(1, 101)
        fits = [r for r in held if r >= wanted]
        assert tree.least(wanted) == (min(fits) if fits else None)
        if held and draw.random() < 0.5:
            r = held.pop(draw.randrange(len(held)))
            tree.add(r, -1)
        else:
            held.append(r := draw.randrange(1, 101))
            tree.add(r, 1)


def test_best_fit_decreasing_against_brute_force():
    draw = random.Random(2)
    for _ in range(50):
        sizes = [draw.randrange(1, 51) for _ in range(40)]
        rooms, want = [], []
        for i in sorted(range(40), key=lambda i: (-sizes[i], i)):
            fits = [(r, k) for k, r in enumerate(rooms) if r >= sizes[i]]
            if fits:
                least = min(r for r, _ in fits)
                k = [k for r, k in fits if r == least]
                rooms[k[0]] -= sizes[i]
            else:
                rooms.append(50 - sizes[i])
        want = len(rooms)
        rows = tokens.best_fit_decreasing(sizes, 50)
        assert len(rows) == want and sorted(i for r in rows for i in r) == list(range(40)) and all(sum(sizes[i] for i in r) <= 50 for r in rows)


def test_tokens_round_trip(spark):
    import tiktoken

    encoder = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.VOCABULARY), special_tokens={})
    df = awkward(spark)
    got = tokens.pack_tokens(df, length=512, window_bytes=100_000).toPandas()
    back: dict = {}
    for r in got.itertuples():
        ids = tokens.matrix([r.input_ids], 512)[0]
        assert len(ids) == 512 and r.cu_seqlens[-1] == r.n_tokens and list(r.position_resets) == list(r.cu_seqlens[:-1])
        assert (tokens.positions(r.cu_seqlens, 512)[list(r.position_resets)] == 0).all()
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            back.setdefault(None if d != d else d, []).append((s, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]))
    texts = {}
    for r in df.filter("length(text) > 0").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert back.keys() == texts.keys() and got.row_id.is_unique
    assert encoder.decode(np.concatenate([x for _, x in sorted(back[6], key=lambda p: p[0])]).tolist()) == LONG
    assert sum(len(x) for v in back.values() for _, x in v) == got.n_tokens.sum() == sum(len(encoder.encode_ordinary(t)) for v in texts.values() for t in v)
    assert tokens.pack_tokens(empty(spark)).count() == 0


def test_matrix_table_round_trip(spark, tmp_path):
    packed = tokens.pack_tokens(spark.createDataFrame([(i, words(i, 300), "s") for i in range(20)], SCHEMA), length=256)
    read = tokens.write_matrices(packed, str(tmp_path / "m"))
    assert tokens.matrix([r.input_ids for r in read.collect()], 256).shape == (packed.count(), 256)


# packing


def test_variable_packing_invariants_and_prices():
    draw = random.Random(4)
    for lengths in ((100,), (16, 64, 256), (7, 13, 100)):
        sizes = [draw.randrange(1, max(lengths) + 1) for _ in range(300)]
        bins, offset, capacity = packing.pack(sizes, lengths)
        spans: dict = {}
        for b, o, n in zip(bins, offset, sizes, strict=True):
            spans.setdefault(b, []).append((o, n))
        for b, held in spans.items():
            held.sort()
            assert held[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(held, held[1:], strict=False))
            used = sum(n for _, n in held)
            assert capacity[b] == min(x for x in lengths if x >= used)
        assert len(spans) == len(capacity)


def test_opens_the_cheapest_length():
    own = lambda sizes: packing.Opener(sizes, (16, 64), 8, 1 << 20)
    assert own([10])(0) == 16 and own([10] * 100)(0) == 64 and own([60])(0) == 64
    # attention makes long bins dear, however full
    assert packing.Opener([10] * 100, (16, 64), 1, 8)(0) == 16
    assert packing.Opener([10, 5, 4, 3, 3, 1], (16, 64), 8, 1 << 20).filled(0, 20) == 20


def cheapest(sizes, lengths, bin_price, span):
    """The least price of all ways to put the pieces into bins."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(packing.price(min(x for x in lengths if x >= b), bin_price, span) for b in bins))
            return
        for k in range(len(bins) + 1):
            now = [*bins, 0] if k == len(bins) else list(bins)
            if now[k] + sizes[i] <= max(lengths):
                now[k] += sizes[i]
                go(i + 1, now)

    go(0, [])
    return best[0]


def total_price(capacity, bin_price, span):
    return sum(packing.price(c, bin_price, span) for c in capacity)


def test_packing_against_all_ways_to_pack():
    draw, ratios = random.Random(8), []
    for _ in range(40):
        lengths = sorted(draw.sample((8, 12, 16, 24, 32, 48), 3))
        sizes = [draw.randrange(1, max(lengths) + 1) for _ in range(draw.randrange(1, 8))]
        bin_price, span = draw.choice((1, 4, 16)), draw.choice((16, 64, 1000))
        got = total_price(packing.pack(sizes, lengths, bin_price, span)[2], bin_price, span)
        ratios.append(got / cheapest(sizes, lengths, bin_price, span))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.05


def test_several_lengths_cost_less_than_any_single_one():
    draw = random.Random(9)
    sizes = [min(8192, int(draw.paretovariate(1.1) * 60)) for _ in range(4000)]
    capacity = packing.pack(sizes)[2]
    joint = total_price(capacity, packing.BIN_PRICE, packing.SPAN)
    assert len(set(capacity)) >= 4
    longest = packing.pack(sizes, (8192,))[2]
    assert joint < 0.9 * total_price(longest, packing.BIN_PRICE, packing.SPAN)
    for least in packing.LENGTHS:  # one length for all that fit it, the next longer one for others
        assert joint <= total_price(packing.pack(sizes, [n for n in packing.LENGTHS if n >= least])[2], packing.BIN_PRICE, packing.SPAN) + 1e-6


def test_pack_blocks_is_lossless(spark):
    df = awkward(spark)
    got = packing.pack_blocks(df, lengths=(128, 1024)).toPandas()
    total = got.groupby(got.doc_id.fillna(-1)).length.sum()
    assert total[6] == 120_000 and total[1] == 15 and total[8] == 18 and total[2] == 0
    assert (got[got.length == 0].capacity == 0).all() and got[got.length == 0].bin_id.isna().all()
    own = got[got.length > 0].groupby("bin_id").agg(n=("length", "sum"), c=("capacity", "first"))
    assert (own.n <= own.c).all()
    long = got[got.doc_id == 6].sort_values("piece")
    assert long.start.tolist() == [0, *long.length.cumsum().tolist()[:-1]] and (long.n_pieces == len(long)).all()
    assert packing.pack_blocks(empty(spark)).count() == 0


def test_pack_spreads_one_id_over_blocks(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 500, SCHEMA)
    got = packing.pack_blocks(df, lengths=(8, 32), block_rows=50).toPandas()
    assert len(got) == 500 and (got.bin_id // (1 << 32)).nunique() == 10


# licences


@pytest.mark.parametrize("text, want", [
    ("Some words.\nReleased under the MIT License.\nMore", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", "Apache-2.0"), ("All about licenses and warranty.", ""), ("", ""), (None, ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. other words. If a copy of the MPL was not\ndistributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.", ""),
])
def test_licence_rules(spark, text, want):
    got = licenses.scan(spark.createDataFrame([(1, text, "s")], SCHEMA)).collect()[0]
    assert got.licenses == want


@pytest.mark.parametrize(("text", "want"), [
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.", "GPL-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0"), ("# SPDX-License-Identifier: EPL-2.0\n", "EPL-2.0"), ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0"),
    ("This library is licensed under the ISC license.", "ISC"), ("It is not licensed under the ISC licence of others.", ""),
])
def test_licence_families(spark, text, want):
    assert licenses.scan(spark.createDataFrame([(1, text, "s")], SCHEMA)).collect()[0].licenses == want


def test_licence_order_and_implication(spark):
    bsd = [licenses.SENTENCES[i] for i in (18, 19, 20, 21)]
    rows = [(1, ". ".join(bsd) + ".", ""), (2, ". ".join(bsd[:3]) + ".", ""), (3, ". ".join([bsd[2], bsd[1], bsd[0]]) + ".", "")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: ""}


def test_every_known_sentence_is_recognised(spark):
    rows = [(i, f"Some words here. {s}.\nMore of it", "") for i, s in enumerate(licenses.SENTENCES)]
    got = {r.doc_id: r.by_line for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"|{i}|" for i in range(len(licenses.SENTENCES))}
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    assert licenses.scan(spark.createDataFrame([(1, gpl, "")], SCHEMA)).collect()[0].licenses == "GPL-3.0"


def test_licences_awkward(spark):
    assert licenses.scan(awkward(spark)).count() == 13 and licenses.scan(empty(spark)).count() == 0


# transport streams


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 159, 160, 161, 162, 163, 164, 170, 175, 176, 183, 184, 185, 4095, 4096, 4097, 40_000])
def test_transport_round_trip(n):
    data = random.Random(n).randbytes(n)
    stored = transport.payload(data)
    assert len(stored) % 64 == 0 and len(stored) >= 64 and stored.startswith(data)
    found = transport.demux(transport.mux(stored))
    assert b"".join(u[3] for u in found["units"][transport.DATA_PID]) == stored
    assert found["errors"] == found["skipped"] == 0
    units = found["units"][transport.DATA_PID]
    assert [u[0] for u in units] == [k * transport.UNIT_TICKS for k in range(len(units))] and [u[2] for u in units] == [k % 8 == 0 for k in range(len(units))]


def test_transport_damage():
    media = transport.mux(random.Random(1).randbytes(64_000))
    lost = media[: 188 * 50] + media[188 * 51 :]
    assert transport.demux(lost)["errors"] >= 1
    twice = media[: 188 * 51] + media[188 * 50 :]
    assert transport.demux(twice)["errors"] == 0
    assert transport.demux(b"junk" + media)["errors"] == 0
    assert transport.demux(None)["packets"] == transport.demux(b"\x47").get("packets") == 0
    wrong = bytearray(media)
    wrong[188 * 10] = 0
    assert transport.demux(bytes(wrong))["skipped"] == 1


def spread(pid, tables, room=184):
    """Packets of sections that follow one another without stuffing between them."""
    data, starts, at = b"".join(tables), [], 0
    for t in tables:
        starts.append(at)
        at += len(t)
    out, at, count = [], 0, 0
    while at < len(data):
        begins = [s - at for s in starts if at <= s < at + room - 1]
        part = (bytes([begins[0]]) if begins else b"") + data[at : at + room - bool(begins)]
        at += room - bool(begins)
        out.append(bytes([transport.SYNC, (0x40 if begins else 0) | pid >> 8, pid & 255, 0x10 | count % 16]) + part.ljust(184, b"\xff"))
        count += 1
    return b"".join(out)


def section(table_id, number, body):
    packed = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return packed + transport.crc_mpeg(packed).to_bytes(4, "big")


def test_late_tables_are_read():
    media = transport.mux(random.Random(2).randbytes(64_000))
    whole, filler = transport.demux(media), bytes([transport.SYNC, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    late = transport.demux(media[:188] + filler * 70 + media[188:])
    assert late["units"] == whole["units"] and late["programs"] == whole["programs"]


def test_sections_over_packets():
    entry = lambda pid: b"\x06" + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00"
    pids = range(0x200, 0x200 + 150)
    pmt = [section(2, n, (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + b"".join(entry(p) for p in own)) for n, own in ((1, pids), (2, [0x400]), (3, [0x401]))]
    pat = section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | 0x100).to_bytes(2, "big") for n in range(1, 101)))
    media = spread(0, [pat]) + spread(0x100, pmt)
    got = transport.demux(media)["programs"]
    assert len(got) == 100 and set(got[1]["streams"]) == set(pids) and set(got[2]["streams"]) == {0x400} and set(got[3]["streams"]) == {0x401}
    lost = transport.demux(spread(0, [pat]) + spread(0x100, pmt)[:188] + spread(0x100, pmt)[376:])["programs"]
    assert lost[1]["streams"] == {} and set(lost[3]["streams"]) == {0x401}


def by_hand(head, body):
    return bytes.fromhex(head) + body + b"\xff" * (188 - len(bytes.fromhex(head)) - len(body))


PAT_BY_HAND = bytes.fromhex("0000b00d0001c100000001f0002ab104b2")  # program 1 at PID 0x1000
PMT_BY_HAND = bytes.fromhex("0002b0170001c10000e100f0001be100f0000fe101f0002f44b99b")  # H.264 at 0x100, which has the clock, AAC at 0x101


def test_a_stream_written_by_hand():
    video = bytes.fromhex("000001e00000808005210007d861") + bytes(range(100))
    audio = bytes.fromhex("000001c0000d8080052100075f47") + bytes(5)
    room = 188 - 4 - 8 - len(video)
    first = bytes.fromhex("47410030") + bytes([7 + room, 0x50]) + bytes(6) + b"\xff" * room + video
    second = bytes.fromhex("47410130") + bytes([183 - len(audio), 0]) + b"\xff" * (182 - len(audio)) + audio
    media = by_hand("47400010", PAT_BY_HAND) + by_hand("47500010", PMT_BY_HAND) + first + second
    assert len(media) == 4 * 188
    got = transport.demux(media)
    assert got["programs"] == {1: {"pcr": 0x100, "version": 0, "streams": {0x100: 0x1B, 0x101: 0x0F}, "pmt": 0x1000}}
    assert got["units"] == {0x100: [(126000, 126000, True, bytes(range(100)))], 0x101: [(transport.read_stamp(bytes.fromhex("2100075f47")), transport.read_stamp(bytes.fromhex("2100075f47")), False, bytes(5))]}
    assert got["errors"] == got["skipped"] == 0


def test_versions_of_tables():
    def table(version, current, pids):
        body = (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + b"".join(b"\x06" + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for p in pids)
        packed = bytes([2]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + b"\x00\x01" + bytes([0xC0 | version << 1 | current, 0, 0]) + body
        return packed + transport.crc_mpeg(packed).to_bytes(4, "big")

    pat = section(0, 1, b"\x00\x01" + (0xE000 | 0x100).to_bytes(2, "big"))
    media = spread(0, [pat]) + spread(0x100, [table(0, 1, [0x200]), table(0, 1, [0x200]), table(1, 0, [0x300]), table(2, 1, [0x200, 0x201])])
    got = transport.demux(media)["programs"][1]
    assert got["version"] == 2 and set(got["streams"]) == {0x200, 0x201}


def test_streams_awkward(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"\x47"), (None, transport.mux(bytes(64))), (4, transport.mux(bytes(2_000_000))), (4, transport.mux(bytes(2_000_000)))], "doc_id long, units binary")
    got = transport.demux_column(df, "units", "doc_id").toPandas()
    assert len(got) == 6 and got[got.id.isin([1, 2, 3])].units.map(len).sum() == 0 and got[got.id == 4].units.map(len).tolist() == [489, 489]
    assert transport.demux_column(df.limit(0), "units", "doc_id").count() == 0
    stored = transport.store_digests(awkward(spark)).toPandas()
    assert len(stored) == 13 and stored[stored.doc_id == 2].iloc[0].payload_bytes == 64 and stored.groupby("n_bytes").media_sha256.nunique().max() >= 1
    assert transport.store_digests(empty(spark)).count() == 0


def test_time_stamps_of_33_bits():
    for ticks in (0, 1, 90_000, (1 << 33) - 1, 0x155555555):
        assert transport.read_stamp(transport.stamp(2, ticks)) == ticks


def test_store_digests(spark):
    got = {r.doc_id: r for r in transport.store_digests(awkward(spark)).collect()}
    raw = LONG.encode()
    back = transport.payload(raw)
    assert got[6].n_bytes == len(raw) and got[6].payload_sha256 == hashlib.sha256(back).hexdigest() and got[6].tail_crc32 == zlib.crc32(back[-64:])
    assert got[2].payload_bytes == got[3].payload_bytes == 64 and got[2].media_sha256 == got[3].media_sha256
    assert got[1].media_sha256 == got[7].media_sha256 and got[1].feature == got[7].feature
    assert transport.store_digests(empty(spark)).count() == 0


def test_demux_column(spark):
    df = spark.createDataFrame([(1, bytearray(transport.mux(b"x" * 10_000))), (2, None), (3, bytearray(b"no stream"))], "id long, data binary")
    got = {r.id: r for r in transport.demux_column(df, "data", "id").collect()}
    assert b"".join(bytes(u.data) for u in got[1].units) == b"x" * 10_000 and got[1].units[0].stream_type == transport.STREAM_TYPE
    assert got[2].packets == 0 and got[3].units == []


# shards


def test_rebalance_moves_little_and_only_into_the_new_shard():
    draw = random.Random(5)
    sizes = [draw.randrange(1000, 2000) for _ in range(4096)]
    one = shards.first_map(sizes, [1] * 4096, 16)
    assert max(one.loads()) - min(one.loads()) < 2000
    two = shards.rebalance(one, 17)
    moved = [(a, b) for a, b in zip(one.shard_of, two.shard_of, strict=True) if a != b]
    assert two.version == 2 and all(b == 16 for _, b in moved) and len(moved) < 4096 / 16
    assert max(two.loads()) - min(two.loads()) < 6000
    three = shards.rebalance(two, 12)
    assert set(three.shard_of) == set(range(12)) and all(a == b for a, b in zip(two.shard_of, three.shard_of, strict=True) if a < 12 and b == a)


def test_stored_maps(spark, tmp_path):
    one = shards.first_map([5, 4, 3, 0], [1, 1, 1, 0], 2)
    one.save(spark, str(tmp_path / "map"))
    shards.rebalance(one, 3).save(spark, str(tmp_path / "map"))
    assert shards.load_map(spark, str(tmp_path / "map"), 1) == one and shards.load_map(spark, str(tmp_path / "map")).version == 2


def test_shard_positions_and_balance(spark):
    df = spark.createDataFrame([(i, words(i, 5 + i % 40), "s") for i in range(4000)], SCHEMA)
    got = shards.shard(df, 8, n_slots=512).toPandas()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    by = got.groupby("shard")["size"].sum()
    assert by.max() / by.min() < 1.01 and len(by) == 8
    first = df.filter("doc_id = 7").collect()[0].text.encode()
    mine = got[got.doc_id == 7].iloc[0]
    assert mine["size"] == len(first) + 1 and mine.text_crc32 == zlib.crc32(first)


def test_repeated_rows_are_spread_by_bytes(spark):
    df = spark.createDataFrame([(1, "a b c d", "s")] * 3000 + [(i, words(i, 3), "s") for i in range(2, 300)], SCHEMA)
    got = shards.shard(df, 8).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(got) == 3298 and len(by) == 8 and by.max() / by.min() < 1.1
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_shards_awkward(spark):
    got = shards.shard(awkward(spark), 3).toPandas()
    assert len(got) == 13 and got.shard.between(0, 2).all() and got[got.doc_id == 2].iloc[0]["size"] == 1
    assert shards.shard(empty(spark), 3).count() == 0


# Order MinHash


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(values, seed=42):
    import xxhash

    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed=seed).intdigest()
    return _signed(seed)


def xxh_int(n, seed):
    """XXH64 of a 32-bit integer as Spark hashes it."""
    m, p1, p2, p3, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    h = (seed + p5 + 4) & m
    h ^= (n & 0xFFFFFFFF) * p1 & m
    h = ((h << 23 | h >> 41) & m) * p2 + p3 & m
    h ^= h >> 33
    h = h * p2 & m
    h ^= h >> 29
    h = h * p3 & m
    return _signed(h ^ h >> 32)


def test_edited_texts_and_likeness(spark):
    texts = {i: words(i, 1 + i * 3 % 80) for i in range(60)} | {60: "", 61: "é" * 33, 62: words(5, 15), 63: words(5, 15)}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in fingerprints.edited_pairs(df).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        same = sum(x == y for x, y in zip(brute_order_minhash(t), brute_order_minhash(after), strict=True))
        assert got[i].near_next == pytest.approx(same / fingerprints.BINS)
    assert got[62].near_next == 1.0 and got[62].fingerprint == got[63].fingerprint and 0 <= got[10].near_edited <= 1


@pytest.mark.parametrize("ranges, cuts", [(1, 512), (3, 512), (50, 512), (50, 7), (400, 3)])
def test_next_document_over_ranges(spark, ranges, cuts):
    from pyspark.sql import functions as F

    rows = [(i * i - 700, f"text {i}") for i in range(100)] + [(500_000, f"hot {i}") for i in range(90)] + [(1 << 62, "far"), (-(1 << 62), "low")] + [(None, f"none {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "_id long, _text string").repartition(4)
    dealt, window = fingerprints.with_next(df, rows_a_range=-(-len(rows) // ranges), most_cuts=cuts)
    got = {r._text: r.n for r in dealt.withColumn("n", F.lead("_text").over(window)).filter("not _copy").collect()}
    order = [r._text for r in df.orderBy(F.col("_id").asc_nulls_last(), F.xxhash64("_text")).collect()]
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))
    if ranges == 50 and cuts == 512:
        assert dealt.filter("_text like 'hot%'").select("_range").distinct().count() > 5


def test_fingerprints_awkward(spark):
    got = fingerprints.edited_pairs(awkward(spark)).toPandas()
    assert len(got) == 13 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got[got.doc_id == 8].fingerprint.nunique() == 1
    assert fingerprints.edited_pairs(empty(spark)).count() == 0
    alone = fingerprints.edited_pairs(spark.createDataFrame([(1, "a b c d e f g h", "s")], SCHEMA)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def brute_order_minhash(text):
    import re

    f, m = fingerprints, 1 << 64
    w = re.split(r"[\x20\x09-\x0D]+", text)
    seen: dict = {}
    ids = []
    for i in range(max(1, len(w) - f.K + 1)):
        h = _hash((w[i : i + f.K] + [None] * f.K)[: f.K]) >> f.PLACE
        n = seen[h] = seen.get(h, -1) + 1
        ids.append((xxh_int(n, _hash([h]) % m) >> f.PLACE) % (1 << 36))
    out = []
    for k in range(f.BINS):
        j, i = divmod(k, f.BINS // f.BASES)
        unsigned = sorted((xxh_int(j, _hash([x]) % m) % m ^ i << f.ORDER_SHIFT, p) for p, x in enumerate(ids))[: f.PICKED]
        picked = [(h - (1 << 63), p) for h, p in unsigned]
        out.append(k << (f.BIN_SHIFT - 32) | (_hash([h for h, _ in sorted(picked, key=lambda p: p[1])]) % m) >> (96 - f.BIN_SHIFT))
    return out


def test_order_minhash_against_brute_force(spark):
    texts = [words(i, 3 + i * 7, 50) for i in range(20)] + ["", "one", "a b", "a b c d", "a a a a a a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in fingerprints.order_minhash(df, "t", "fp").collect():
        assert r.fp == brute_order_minhash(r.t), r.t


@pytest.mark.parametrize("n", [20, 40, 80])
def test_swapped_halves_are_half_alike(spark, n):
    rows = []
    for k in range(30):
        w = words(k, n, 10_000).split()
        rows.append((" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    df = spark.createDataFrame(rows, "a string, b string")
    both = fingerprints.order_minhash(fingerprints.order_minhash(df, "a", "x"), "b", "y").select(fingerprints.likeness("x", "y").alias("l"))
    common = n - 4  # of n k-mers in either text; both picks must be of these, and of one half
    assert both.agg({"l": "avg"}).first()[0] == pytest.approx(common * (common / 2 - 1) / (n * (n - 1)), abs=0.05)


def test_registered_fingerprints_see_order_in_short_texts(spark, tmp_path):
    from siltstone.llm.queries import op10_fingerprints

    rows = []
    for k in range(20):
        w = words(k, 60, 10_000).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[30:] + w[:30]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.near_next for r in op10_fingerprints(spark, str(tmp_path)).collect() if r.doc_id % 2 == 0]
    assert sum(got) / len(got) < 0.55
