"""The results of the operators in SQL, for the engine that checks the registered queries."""

from __future__ import annotations

# All documents with their words, as the operators see them: ids once, without null.
DOCS = r"""
docs as (
    select doc_id, text from (
        select doc_id, text, row_number() over (partition by doc_id order by text nulls first) k
        from documents where doc_id is not null
    ) where k = 1
),
split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from docs)"""


def components(nodes: str, links: str) -> str:
    """Common tables that end in ``component (id, root)``; ``links`` (a, b) in both directions."""
    return f"""
reached(id, root) as (
    select id, id from {nodes}
    union
    select l.b, r.root from reached r join {links} l on l.a = r.id
),
component as (select id, min(root) root from reached group by id)"""


LINE_DEDUP = rf"""
with {DOCS},
raw as (select doc_id, coalesce(string_split(text, chr(10)), []) ls from docs),
lines as (
    select doc_id, k - 1 line_no, ls[k] line, regexp_extract_all(ls[k], '[^\x20\x09-\x0D]+') ws
    from (select doc_id, ls, unnest(range(1, len(ls) + 1)) k from raw)
),
long as (
    select doc_id, line_no, ws, len(ws) n, row(doc_id, line_no) place, md5_number(array_to_string(ws, ' ')) whole
    from lines where len(ws) >= 5
),
first as (select * from (select *, row_number() over (partition by whole order by place) k from long) where k = 1),
variants as (
    select place, whole, p, md5_number(array_to_string(list_concat(ws[:p - 1], ws[p + 1:]), ' ')) v
    from (select *, unnest(range(1, n + 1)) p from first)
),
replaced as (select place from (select place, min(place) over (partition by v, p) f from variants) where f < place),
put_in as (select v.place variant, f.place line from variants v join first f on f.whole = v.v),
gone as (
    select l.doc_id, l.line_no from long l join first f using (whole) where l.place <> f.place
    union select f.doc_id, f.line_no from first f where f.place in (
        select place from replaced union select variant from put_in where line < variant union select line from put_in where variant < line
    )
),
kept as (
    select l.doc_id, count(g.line_no) n_removed, string_agg(l.line, chr(10) order by l.line_no) filter (g.line_no is null) t
    from lines l left join gone g on g.doc_id = l.doc_id and g.line_no = l.line_no group by l.doc_id
)
select r.doc_id, len(r.ls)::bigint n_lines, coalesce(k.n_removed, 0)::bigint n_removed,
    case when d.text is not null then sha256(coalesce(k.t, '')) end kept_sha256
from raw r join docs d using (doc_id) left join kept k using (doc_id)"""

SUBSTRING_DEDUP = rf"""
with {DOCS},
windows as (
    select doc_id, i, array_to_string(ws[i:i + 12], ' ') g
    from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from split)
),
first as (select g, min(doc_id) f from windows group by g),
gone as (select distinct doc_id, i + k p from (select w.doc_id, w.i from windows w join first using (g) where f < w.doc_id), range(13) t(k)),
spread as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) p from split),
kept as (
    select s.doc_id, count(g.p) n_removed, string_agg(s.word, ' ' order by s.p) filter (g.p is null) t
    from spread s left join gone g on g.doc_id = s.doc_id and g.p = s.p group by s.doc_id
)
select s.doc_id, len(s.ws)::bigint n_words, coalesce(k.n_removed, 0)::bigint n_removed, sha256(coalesce(k.t, '')) kept_sha256
from split s left join kept k using (doc_id)"""

QUALITY = rf"""
with {DOCS},
spread as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) p from split),
windows as (
    select doc_id, size, i, md5_number(array_to_string(ws[i:i + size - 1], ' ')) g
    from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) i from split, (values (5), (10), (101)) s(size))
),
twice as (select doc_id, size, i from (select *, count(*) over (partition by doc_id, size, g) n from windows) where n > 1),
hit as (select doc_id, size, count(distinct i + k) n from twice, range(101) t(k) where k < size group by all),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from docs),
repeated as (
    select doc_id, (count(*) - count(distinct line))::bigint n from lines
    where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0 group by doc_id
),
base as (
    select d.doc_id, len(s.ws)::bigint n_words, coalesce((select sum(length(word)) from spread x where x.doc_id = d.doc_id), 0)::bigint word_chars,
        len(regexp_extract_all(coalesce(d.text, ''), '[#*$%&|<>]'))::bigint n_symbols, coalesce(r.n, 0)::bigint n_dup_lines,
        coalesce(h5.n, 0)::bigint n_repeat_words, coalesce(h10.n, 0)::bigint n_covered_words, h101.n is not null too_long
    from docs d join split s using (doc_id) left join repeated r using (doc_id)
    left join hit h5 on h5.doc_id = d.doc_id and h5.size = 5
    left join hit h10 on h10.doc_id = d.doc_id and h10.size = 10
    left join hit h101 on h101.doc_id = d.doc_id and h101.size = 101
),
failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
    not base_failed and 100 * n_covered_words <= 20 * n_words and not too_long kept
from failed"""

NEAR_DUPLICATES = rf"""
with recursive {DOCS},
small as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
    from docs
),
shingles as (
    select distinct doc_id, array_to_string(ws[i:i + 4], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from small where len(ws) > 0)
),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
near as (select a, b from pairs p join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * p.n >= 85 * (x.n + y.n - p.n)),
links as (select a, b from near union all select b, a from near),
ids as (select doc_id id from docs),
{components("ids", "links")}
select d.doc_id, coalesce(s.n, 0)::bigint n_shingles, c.root component_id, d.doc_id = c.root kept
from docs d left join sizes s using (doc_id) join component c on c.id = d.doc_id"""

SUFFIX_DEDUP = rf"""
with {DOCS},
bytes as (select doc_id, hex(encode(coalesce(text, ''))) h from docs),
windows as (
    select doc_id, unnest(gs) g, generate_subscripts(gs, 1) i
    from (select doc_id, list_transform(range(1, len(h) // 2 - 98), lambda i: md5_number(substr(h, 2 * i - 1, 200))) gs from bytes)
),
hits as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) k from windows) where k > 1),
spread as (select doc_id, unnest(bs) b, generate_subscripts(bs, 1) i from (select doc_id, regexp_extract_all(h, '..') bs from bytes)),
marked as (
    select s.doc_id, s.i, s.b, coalesce(s.i - max(t.i) over (partition by s.doc_id order by s.i) < 100, false) gone
    from spread s left join hits t on t.doc_id = s.doc_id and t.i = s.i
),
edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) first from marked),
kept as (
    select doc_id, count(*) filter (gone) n_removed, count(*) filter (first) n_spans, string_agg(b, '' order by i) filter (not gone) t
    from edges group by doc_id
)
select b.doc_id, (len(b.h) // 2)::bigint n_bytes, coalesce(k.n_removed, 0)::bigint n_removed, coalesce(k.n_spans, 0)::bigint n_spans,
    sha256(unhex(coalesce(k.t, ''))) kept_sha256
from bytes b left join kept k using (doc_id)"""

NEAR_VECTORS = f"""
with recursive vectors as (
    select vec_id, embedding::double[] v from embeddings where vec_id is not null
),
good as (
    select vec_id, v from vectors
    where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
),
links as (
    select x.vec_id a, y.vec_id b from good x join good y on x.vec_id <> y.vec_id and len(x.v) = len(y.v)
    where case when len(x.v) = len(y.v) then list_cosine_similarity(x.v, y.v) >= 0.95 end
),
ids as (select vec_id id from vectors),
{components("ids", "links")}
select e.vec_id, (select count(*) from links l where l.a = e.vec_id)::bigint n_links, c.root component_id, e.vec_id = c.root kept
from vectors e join component c on c.id = e.vec_id"""

# A-Z in lower case, all else as it is.
SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED_SEARCH = rf"""
with {DOCS},
terms as (select doc_id, unnest(regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
tfs as (select doc_id, term, count(*) tf from terms group by all),
lengths as (select doc_id, sum(tf)::bigint n from tfs group by doc_id),
total as (select count(*) n_docs, sum(n)::bigint n_terms from lengths),
weights as (
    select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint w
    from (select term, count(*) df from tfs group by term), total
),
items as (
    select item_id, text from (
        select item_id, text, row_number() over (partition by item_id order by text nulls first) k from benchmark where item_id is not null
    ) where k = 1
),
asked as (select distinct item_id, unnest(regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from items),
scores as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint score
    from asked join weights using (term) join tfs using (term) join lengths using (doc_id), total group by all
),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int "rank" from scores where score > 0)
select item_id, "rank", doc_id, score from ranked where "rank" <= 10"""

RESAMPLING = rf"""
with {DOCS},
-- the remainders of one byte, from the polynomial, and the checksum of a text byte by byte
bits as (select list(list_reduce(list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) t from range(256) r(b)),
texts as (
    select doc_id, 0 side, {SMALL} t from docs
    union all select row_number() over (), 1, {SMALL} from benchmark
),
words as (select doc_id, side, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from texts),
runs as (
    select doc_id, side, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) f from words
),
known as (select f, regexp_extract_all(hex(encode(f)), '..') bs from (select distinct f from runs)),
hashed as (
    select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(bs, lambda b: ('0x' || b)::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 bucket
    from known, bits
),
features as (select doc_id, side, bucket from runs join hashed using (f)),
counts as (select bucket, count(*) filter (side = 0) s, count(*) filter (side = 1) t from features group by bucket),
total as (select count(*) filter (side = 0) s_all, count(*) filter (side = 1) t_all from features),
gains as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint gain from counts, total),
weighed as (select doc_id, count(*) n, sum(gain)::bigint g from features join gains using (bucket) where side = 0 group by doc_id),
scored as (
    select w.doc_id, len(ws) n_words, coalesce(n, 0)::bigint n_features, coalesce(floor(g / n), 0)::bigint weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint draw
    from words w left join weighed using (doc_id) where side = 0
),
able as (select doc_id, row_number() over (order by weight + draw desc, doc_id) k, count(*) over () n from scored where n_words >= 20)
select s.doc_id, n_features, weight, weight + draw score, case when k <= 25 * n // 100 then k end::bigint "rank"
from scored s left join able using (doc_id)"""
