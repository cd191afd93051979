"""Writes small bigWig files, for tests: all kinds of blocks, either byte order, trees of several levels."""

import struct
import zlib


def write(path, sizes, blocks, order="<", packed=True, fan=3):
    """sizes: {chrom: length}; blocks: [(chrom, kind, step, span, [(start, end, value)])] by place."""
    number = {c: i for i, c in enumerate(sorted(sizes))}
    pack = lambda layout, *x: struct.pack(order + layout, *x)
    key = max(map(len, sizes))
    out = bytearray(64)

    def tree(items, head, leaf_item, node_item, cover):
        """The levels of a tree behind its head, root first; node items hold what their child covers."""
        levels = [[items[i : i + fan] for i in range(0, len(items), fan)]]
        while len(levels[0]) > 1:
            levels.insert(0, [levels[0][i : i + fan] for i in range(0, len(levels[0]), fan)])
        nodes, at = [], head
        size = lambda node, leaf: 4 + len(node) * struct.calcsize("=" + (leaf_item if leaf else node_item))
        offsets = []
        for d, level in enumerate(levels):
            offsets.append([])
            for node in level:
                offsets[-1].append(at)
                at += size(node, d == len(levels) - 1)
        for d, level in enumerate(levels):
            leaf = d == len(levels) - 1
            child = 0
            for node in level:
                data = pack("BBH", leaf, 0, len(node))
                for x in node:
                    if leaf:
                        data += pack(leaf_item, *x)
                    else:
                        data += pack(node_item, *cover(x), offsets[d + 1][child])
                        child += 1
                nodes.append(data)
        return b"".join(nodes)

    def flat(x):
        return [x] if isinstance(x, tuple) else [z for y in x for z in flat(y)]

    names_at = len(out)
    out += pack("IIIIQQ", 0x78CA8C91, fan, key, 8, len(sizes), 0)
    out += tree([(c.encode(), number[c], sizes[c]) for c in sorted(sizes)], len(out), f"{key}sII", f"{key}sQ", lambda x: (flat(x)[0][0],))
    data_at = len(out)
    out += pack("Q", len(blocks))
    places = []
    for chrom, kind, step, span, rows in blocks:
        body = pack("IIIIIBBH", number[chrom], rows[0][0], rows[-1][1], step, span, kind, 0, len(rows))
        for s, e, v in rows:
            body += pack("IIf", s, e, v) if kind == 1 else pack("If", s, v) if kind == 2 else pack("f", v)
        body = zlib.compress(body) if packed else body
        places.append((number[chrom], rows[0][0], number[chrom], rows[-1][1], len(out), len(body)))
        out += body
    index_at = len(out)
    ends = (*places[0][:2], *max(p[2:4] for p in places)) if places else (0, 0, 0, 0)
    out += pack("IIQIIIIQII", 0x2468ACE0, fan, len(places), *ends, index_at, 1024, 0)
    out += tree(places, len(out), "IIIIQQ", "IIIIQ", lambda x: (*min(p[:2] for p in flat(x)), *max(p[2:4] for p in flat(x)))) or pack("BBH", 1, 0, 0)
    out[:64] = pack("IHHQQQHHQQIQ", 0x888FFC26, 4, 0, names_at, data_at, index_at, 0, 0, 0, 0, 1 << 15 if packed else 0, 0)
    path.write_bytes(bytes(out))
