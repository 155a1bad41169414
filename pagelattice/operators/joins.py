"""Joins inside a page: partitions, problems, separators, neighbours."""

from __future__ import annotations

from .sqlop import operator

operator("partition_compare", "JOIN2 JOIN25 IO32 PROJ64 AGG36 PROJ65", "fx_line", """
with g as (select page_id, gt_id, count(*) as n from fx_line group by page_id, gt_id), h as (select page_id, hyp_id, count(*) as n from fx_line group by page_id, hyp_id),
i as (select page_id, gt_id, hyp_id, count(*) as n from fx_line group by page_id, gt_id, hyp_id)
select page_id, gt_nis, hyp_nis, corrects, splits, merges, splits - merges as dist, gt_nis + splits + merges = hyp_nis as consistent from (
  select i.page_id, cast(count(distinct i.gt_id) as bigint) as gt_nis, cast(count(distinct i.hyp_id) as bigint) as hyp_nis, cast(sum(case when i.n = g.n and i.n = h.n then 1 else 0 end) as bigint) as corrects,
    cast(count(*) - count(distinct i.gt_id) as bigint) as splits, cast(count(distinct i.hyp_id) - count(*) as bigint) as merges
  from i join g on i.page_id = g.page_id and i.gt_id = g.gt_id join h on i.page_id = h.page_id and i.hyp_id = h.hyp_id group by i.page_id) c
""", "Ground truth against hypothesis partition of a page's common lines: blocks, corrects, splits, merges, distance.")
operator("ignored_lines", "SET7", "fx_line fx_sep", """
select l.page_id, l.line_no, l.gt_id from fx_line l where not exists (select 1 from fx_sep s where s.page_id = l.page_id and l.x >= s.x0 and l.x + l.w <= s.x1)
""", "Lines that are not in the set to ignore (here: between the ends of a separator).")
operator("canonical_partition", "AGG35 ITER20", "fx_line", """
select page_id, gt_id, cast(count(*) as bigint) as n, min(line_no) as least_line, dense_rank() over (partition by page_id order by min(line_no)) as place from fx_line group by page_id, gt_id
""", "Articles of a page in the order of their least line.")
operator("check_tl1", "AGG37 PROJ67", "fx_line", """
select page_id, cast(sum(case when txt = 'AF' then 1 else 0 end) as bigint) as no_text, cast(sum(case when nullif(gt_id, 2) is null then 1 else 0 end) as bigint) as no_article from fx_line group by page_id
""", "Lines without text (here: of one kind) and without an article.")
operator("check_tl2", "JOIN3", "fx_line", """
select a.page_id, a.line_no as line_a, b.line_no as line_b, a.txt from fx_line a join fx_line b on a.page_id = b.page_id and a.txt = b.txt and a.line_no < b.line_no where a.txt <> ''
""", "Pairs of lines of a page with one text.")
operator("check_tr", "AGG38", "fx_line", """
select page_id, region_no, cast(count(distinct nullif(gt_id, 2)) as bigint) as n_articles from fx_line group by page_id, region_no having count(distinct nullif(gt_id, 2)) > 1
""", "Regions with lines of several articles.")
_JSON = """concat(chr(123), '"code":"', code, '","n":', cast(n as varchar(20)), chr(125)) as json"""
operator("check_pages", "AGG39 FILT48 SINK11 PROJ66 PROJ68", "fx_line", f"""
with g as (select page_id, region_no, txt, nullif(gt_id, 2) as article, count(*) as n from fx_line group by page_id, region_no, txt, nullif(gt_id, 2)),
t as (select page_id, txt, sum(n) as n from g group by page_id, txt), r as (select page_id, region_no from g group by page_id, region_no having count(distinct article) > 1),
c as (select page_id, 'TL1.2' as code, sum(n) as n from g where article is null group by page_id union all select page_id, 'TL2.1' as code, sum(n * (n - 1) / 2) as n from t group by page_id having sum(n * (n - 1) / 2) > 0
  union all select page_id, 'TR1.1' as code, count(*) as n from r group by page_id)
select page_id, code, cast(n as bigint) as n, {_JSON.replace("cast(n as", "cast(cast(n as bigint) as")} from c
""", "Problems of the selected checks, by page and code; lines of one text are counted as groups, not joined.", other=f"""
select page_id, code, n, {_JSON} from (select page_id, code, count(*) as n from (
  select page_id, 'TL1.2' as code from fx_line where nullif(gt_id, 2) is null
  union all select a.page_id, 'TL2.1' as code from fx_line a join fx_line b on a.page_id = b.page_id and a.txt = b.txt and a.line_no < b.line_no
  union all select page_id, 'TR1.1' as code from (select page_id, region_no from fx_line group by page_id, region_no having count(distinct nullif(gt_id, 2)) > 1) r) p group by page_id, code) q
""")
operator("overwrite_ids", "JOIN4", "fx_line", """
select t.page_id, t.line_no, s.hyp_id as article_id, case when nullif(t.gt_id, 2) is distinct from s.hyp_id then 1 else 0 end as changed from fx_line t join fx_line s on t.page_id = s.page_id and t.line_no = s.line_no
""", "Article ids taken over from another version of the page by line id.")
operator("overwrite_ids_by_region", "JOIN5", "fx_line", """
with m as (select page_id, region_no, a from (select page_id, region_no, a, row_number() over (partition by page_id, region_no order by n desc, a) as rn
  from (select page_id, region_no, nullif(hyp_id, 2) as a, count(*) as n from fx_line where hyp_id <> 2 group by page_id, region_no, nullif(hyp_id, 2)) c) r where rn = 1)
select l.page_id, l.region_no, l.line_no, m.a as article_id from fx_line l join m on l.page_id = m.page_id and l.region_no = m.region_no
""", "Article ids taken over from a region's majority; regions without one are dropped.")
operator("full_edges", "JOIN6 JOIN16 ITER43", "fx_region", """
select a.page_id, a.region_no as src, b.region_no as dst, case when a.region_type = b.region_type then 1 else 0 end as gt from fx_region a join fx_region b on a.page_id = b.page_id and a.region_no <> b.region_no
""", "All ordered pairs of a page's regions with their ground truth relation.")
operator("external_features", "JOIN10", "fx_region fx_sep", """
select r.page_id, r.region_no, coalesce(e.value, d.value, 0.5) as value from fx_region r
left join (select page_id, 2 as region_no, x0 / 1000.0 as value from fx_sep where x0 > 300) e on e.page_id = r.page_id and e.region_no = r.region_no
left join (select page_id, min(y0) / 1000.0 as value from fx_sep where y0 < 100 group by page_id) d on d.page_id = r.page_id
""", "Feature of a region from a table of its own, else the page's default, else a constant.")
operator("gt_relations", "JOIN10", "fx_line", """
with m as (select page_id, region_no, a from (select page_id, region_no, a, row_number() over (partition by page_id, region_no order by n desc, a) as rn
  from (select page_id, region_no, gt_id as a, count(*) as n from fx_line group by page_id, region_no, gt_id) c) r where rn = 1)
select a.page_id, a.region_no as i, b.region_no as j from m a join m b on a.page_id = b.page_id and a.a = b.a and a.region_no <> b.region_no
""", "Pairs of regions of one majority article.")
SEP = "(select *, coalesce(orientation, case when greatest(y1 - y0, 1) * 1.0 / greatest(x1 - x0, 1) < 5 then 'horizontal' else 'vertical' end) as o from fx_sep)"
operator("edge_separator", "JOIN8 FILT26 FILT27 PROJ29", "fx_region fx_sep", f"""
select a.page_id, a.region_no as ra, b.region_no as rb,
  coalesce(max(case when s.o = 'horizontal' and ((a.y0 <= (s.y0 + s.y1) / 2.0 and (s.y0 + s.y1) / 2.0 <= b.y1) or (b.y0 <= (s.y0 + s.y1) / 2.0 and (s.y0 + s.y1) / 2.0 <= a.y1))
    and not ((a.x1 <= s.x0 and b.x1 <= s.x0) or (a.x0 >= s.x1 and b.x0 >= s.x1)) then 1 else 0 end), 0) as hsep,
  coalesce(max(case when s.o = 'vertical' and ((a.x1 <= (s.x0 + s.x1) / 2.0 and (s.x0 + s.x1) / 2.0 <= b.x0) or (b.x1 <= (s.x0 + s.x1) / 2.0 and (s.x0 + s.x1) / 2.0 <= a.x0))
    and ((a.y1 >= s.y0 and a.y0 <= s.y1) or (b.y1 >= s.y0 and b.y0 <= s.y1)) then 1 else 0 end), 0) as vsep
from fx_region a join fx_region b on a.page_id = b.page_id and a.region_no <> b.region_no left join {SEP} s on s.page_id = a.page_id group by a.page_id, a.region_no, b.region_no
""", "Edges between regions with a separator of either orientation between them.")
operator("edge_separator_line", "JOIN9 FILT24 FILT25", "fx_region fx_sep", f"""
select a.page_id, a.region_no as ra, b.region_no as rb, s.o as orientation, cast(count(*) as bigint) as n
from (select *, (x0 + x1) / 2.0 as cx, (y0 + y1) / 2.0 as cy from fx_region) a join (select *, (x0 + x1) / 2.0 as cx, (y0 + y1) / 2.0 as cy from fx_region) b on a.page_id = b.page_id and a.region_no < b.region_no
join {SEP} s on s.page_id = a.page_id
where greatest(least(a.cx, b.cx), s.x0) <= least(greatest(a.cx, b.cx), s.x1) and greatest(least(a.cy, b.cy), s.y0) <= least(greatest(a.cy, b.cy), s.y1)
  and ((a.cx between s.x0 and s.x1 and a.cy between s.y0 and s.y1) or (b.cx between s.x0 and s.x1 and b.cy between s.y0 and s.y1)
    or ((b.cx - a.cx) * (s.y0 - a.cy) - (b.cy - a.cy) * (s.x0 - a.cx)) * ((b.cx - a.cx) * (s.y1 - a.cy) - (b.cy - a.cy) * (s.x1 - a.cx)) <= 0
    or ((b.cx - a.cx) * (s.y0 - a.cy) - (b.cy - a.cy) * (s.x1 - a.cx)) * ((b.cx - a.cx) * (s.y1 - a.cy) - (b.cy - a.cy) * (s.x0 - a.cx)) <= 0)
group by a.page_id, a.region_no, b.region_no, s.o
""", "Lines between region centres that cross a separator's box.")
operator("separated_pairs", "FILT28 FILT29 JOIN17", "fx_region fx_sep", f"""
select a.page_id, a.region_no as i, b.region_no as j,
  max(case when s.o = 'horizontal' and ((a.y0 <= (s.y0 + s.y1) / 2.0 and (s.y0 + s.y1) / 2.0 <= b.y1) or (b.y0 <= (s.y0 + s.y1) / 2.0 and (s.y0 + s.y1) / 2.0 <= a.y1))
    and a.x1 >= s.x0 and b.x1 >= s.x0 and a.x0 <= s.x1 and b.x0 <= s.x1 then 1 else 0 end) as by_separator,
  max(case when a.x0 <= b.x1 and b.x0 <= a.x1 and ((a.t = 'heading' and b.t <> 'heading' and a.y0 >= b.y1) or (b.t = 'heading' and a.t <> 'heading' and b.y0 >= a.y1)) then 1 else 0 end) as by_heading
from (select *, coalesce(region_type, 'paragraph') as t from fx_region) a join (select *, coalesce(region_type, 'paragraph') as t from fx_region) b on a.page_id = b.page_id and a.region_no < b.region_no left join {SEP} s on s.page_id = a.page_id group by a.page_id, a.region_no, b.region_no
""", "Pairs of regions in one column with a horizontal separator between the upper one's top and the lower one's bottom, or of which only the lower one is a heading.")
operator("neighbours_by_confidence", "JOIN13 ITER10", "fx_conf", """
select page_id, i, cast(count(*) as bigint) as n_neighbours, round(avg(p), 6) as mean_p from fx_conf where p > 0.5 and i <> j group by page_id, i
""", "Nodes whose confidence exceeds the threshold.")
operator("blank_rectangles", "JOIN14 SET8", "fx_sep fx_line", """
with a as (select page_id, gt_id, min(x) as x0, max(x + w) as x1, min(y) as y0, max(y + h) as y1 from fx_line group by page_id, gt_id)
select s.page_id, s.x0, s.y0, min(a.gt_id) as article_id from fx_sep s join a on a.page_id = s.page_id and least(s.x1, a.x1) > greatest(s.x0, a.x0) and least(s.y1, a.y1) > greatest(s.y0, a.y0)
group by s.page_id, s.x0, s.y0, s.x1, s.y1 having count(*) = 1
""", "Blank rectangles that meet the bounding box of just one article take its id.")
operator("blank_by_parts", "JOIN15", "fx_sep fx_line", """
with a as (select page_id, gt_id, region_no, min(x) as x0, max(x + w) as x1, min(y) as y0, max(y + h) as y1 from fx_line group by page_id, gt_id, region_no)
select s.page_id, s.x0, s.y0, min(a.gt_id) as article_id, cast(count(*) as bigint) as parts from fx_sep s join a on a.page_id = s.page_id and least(s.x1, a.x1) > greatest(s.x0, a.x0) and least(s.y1, a.y1) > greatest(s.y0, a.y0)
group by s.page_id, s.x0, s.y0, s.x1, s.y1 having count(distinct a.gt_id) = 1
""", "The same for articles of several polygons: the box of each counts.")
operator("split_lines", "JOIN22", "fx_line fx_sep", f"""
select page_id, line_no, part, x0, x1 from (
  select l.page_id, l.line_no, p.part, case when p.part = 0 then l.x else s.x1 end as x0, case when p.part = 0 then s.x0 else l.x + l.w end as x1
  from fx_line l join {SEP} s on s.page_id = l.page_id and s.o = 'vertical' and l.x < s.x0 and s.x1 < l.x + l.w and l.y + l.h >= s.y0 and l.y <= s.y1 cross join (select 0 as part union all select 1 as part) p
  union all select l.page_id, l.line_no, 0 as part, l.x, l.x + l.w from fx_line l where not exists (select 1 from {SEP} s where s.page_id = l.page_id and s.o = 'vertical' and ((l.x < s.x0 and s.x1 < l.x + l.w) or (s.x0 <= l.x and l.x + l.w <= s.x1)) and l.y + l.h >= s.y0 and l.y <= s.y1)) t
""", "Vertical separators cut the lines that cross them and drop the lines that they cover.")
operator("vectors_of_ids", "JOIN24", "fx_vec fx_region", """
select r.page_id, r.region_no, v.label, round(v.v[0] * 1.0, 4) as first_value from fx_region r join fx_vec v on v.page_id = r.page_id and v.node = r.region_no
""", "The vector of each id.", (), (("v.v[0]", "v.v[1]"),))
