"""Minimum-cost flow between a few old and new shards, by successive shortest paths."""


def cheapest_transfers(old: list[int], new: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, as few moved as can be: staying (i == j) costs 0 a byte, moving 1.

    ``new`` must have room for all of ``old``. Each round finds the cheapest path from old shards with bytes left to
    new shards with room left, over edges i -> j and, where bytes flow already, back j -> i at the negative cost,
    and sends as much along it as fits. Costs are 0 and 1 and the rounds a few for each shard, so the graph stays
    small whatever the bytes are.
    """
    if sum(new) < sum(old):
        raise ValueError("the new shards have less room than the old ones hold")
    left, room = list(old), list(new)
    flow: dict[tuple[int, int], int] = {}
    cost = lambda i, j: int(i != j)
    while any(left):
        far = {("old", i): 0 for i, b in enumerate(left) if b}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        for _ in range(len(old) + len(new)):
            changed = False
            for (side, x), d in list(far.items()):
                ways = (
                    [(("new", j), cost(x, j)) for j in range(len(new))]
                    if side == "old"
                    else [(("old", i), -cost(i, x)) for i in range(len(old)) if flow.get((i, x))]
                )
                for to, step in ways:
                    if d + step < far.get(to, 1 << 60):
                        far[to], came[to], changed = d + step, (side, x), True
            if not changed:
                break
        end = min((n for n in far if n[0] == "new" and room[n[1]]), key=lambda n: (far[n], n[1]))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        most = min(left[path[0][1]], room[end[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "new":
                most = min(most, flow[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "old":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + most
            else:
                flow[b[1], a[1]] -= most
        left[path[0][1]] -= most
        room[end[1]] -= most
    return {k: v for k, v in flow.items() if v}
