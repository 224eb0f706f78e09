"""DuckDB SQL for the queries of this subpackage that SQL can express."""

# crc32 of a decimal number: DuckDB has none, so its eight steps a byte are spelt out.
_CRC = """xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(string_split({number}::varchar, ''), lambda c: ord(c)::ubigint)),
    lambda state, byte: list_reduce(
      list_prepend(xor(state, byte), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda bits, step: xor(bits >> 1, 3988292384::ubigint * (bits & 1)))))"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE_MANIFEST = f"""
with recursive told as (
  select doc_id, coalesce('s' || source, '') as tree, {_leaf("text")} as leaf, {_leaf(_LOWER)} as lowered,
    coalesce({_CRC.format(number="doc_id")} % 5 = 0, false) as tampered
  from documents
),
leaves as (
  select *,
    row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by tree) as size
  from told
),
levels as (
  select 0 as level, tree, pos, size, leaf as hash from leaves
  union all
  select level + 1, tree, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' order by pos))
  from levels where size > 1 group by level, tree, pos // 16, size
),
tops as (
  select 0 as level, row_number() over (order by tree) - 1 as pos, count(*) over () as size, hash
  from levels where size = 1
  union all
  select level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' order by pos))
  from tops where size > 1 group by level, pos // 16, size
),
numbers as (select tree, hash as subroot, row_number() over (order by tree) - 1 as tree_no from levels where size = 1),
-- Every node below a root, the source's levels first, with the hashes of its run.
runs as (
  select level, tree, pos // 16 as run, string_agg(hash, '' order by pos) as hashes
  from levels where size > 1 group by level, tree, pos // 16
  union all
  select level + 1000, '', pos // 16, string_agg(hash, '' order by pos)
  from tops where size > 1 group by level, pos // 16
),
climb as (
  select l.pos as id, l.tree as home, l.tree as tree, 0 as level, l.pos as pos, l.size as size, false as at_top,
    case when l.tampered then l.lowered else l.leaf end as fold, '' as proof
  from leaves l
  union all
  select id, home,
    case when size > 1 then c.tree else '' end,
    case when size > 1 then c.level + 1 else 1000 end,
    case when size > 1 then c.pos // 16 else (select n.tree_no from numbers n where n.tree = c.home) end,
    case when size > 1 then (size + 15) // 16 else (select count(*) from numbers) end,
    at_top or size = 1,
    case when size > 1
      then sha256(left(r.hashes, 64 * (c.pos % 16)) || fold || substring(r.hashes, 64 * (c.pos % 16) + 65))
      else fold end,
    case when size > 1
      then proof || left(r.hashes, 64 * (c.pos % 16)) || substring(r.hashes, 64 * (c.pos % 16) + 65)
      else proof end
  from climb c left join runs r on r.level = c.level and r.tree = c.tree and r.run = c.pos // 16
  where size > 1 or not at_top
)
select l.doc_id, l.leaf, n.subroot, t.hash as root, sha256(c.proof) as proof_sha256, c.fold as folded_root,
  c.fold = t.hash as verified
from leaves l
join climb c on c.home = l.tree and c.id = l.pos and c.at_top and c.size = 1
join numbers n on n.tree = l.tree
join tops t on t.size = 1
"""


def _centroids(k: int, rounds: int, dims: int, seed: int) -> str:
    """`rounds` rounds of nearest centroids and exact floors of their means, then one more assignment."""

    def nearest(name: str, centres: str) -> str:
        return f"""{name} as (
  select r.row, arg_min(c.cluster, (d.distance, c.cluster)) as cluster, min(d.distance) as distance
  from kept r, {centres} c,
    lateral (select list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance) d
  group by r.row
)"""

    parts = [
        f"""kept as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({64} * x::double)::bigint) as v
  from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}
)""",
        f"""c0 as (
  select (row_number() over (order by sha256('{seed}:' || vec_id) nulls last, v) - 1)::int as cluster, v
  from kept qualify row_number() over (order by sha256('{seed}:' || vec_id) nulls last, v) <= {k}
)""",
    ]
    for n in range(rounds):
        parts.append(nearest(f"a{n}", f"c{n}"))
        parts.append(f"""m{n} as (
  select cluster, list(mean order by place) as v from (
    select a.cluster, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as mean
    from a{n} a join (select row, unnest(v) as x, unnest(range({dims})) as place from kept) using (row)
    group by a.cluster, place) group by cluster
),
c{n + 1} as (select cluster, coalesce(m.v, c.v) as v from c{n} c left join m{n} m using (cluster))""")
    parts.append(nearest("last", f"c{rounds}"))
    return f"""with {", ".join(parts)}
select k.vec_id, l.cluster, l.distance,
  (sum(l.distance) over (partition by l.cluster))::bigint as cluster_inertia,
  (sum(l.distance) over ())::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from last l join kept k using (row) join c{rounds} c using (cluster)"""


CENTROIDS = _centroids(k=16, rounds=3, dims=64, seed=1)
