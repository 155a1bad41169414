"""Window-like operators, sorts, top-k, set operations and scalar functions."""

from __future__ import annotations

from .sqlop import operator

operator("reading_order", "WIN1 SORT4 PROJ27 PROJ28", "fx_line", """
select page_id, region_no, line_no, row_number() over (partition by page_id, region_no order by y + h / 2.0, x, line_no) - 1 as place from fx_line
""", "Lines of a region by their vertical centre, from 0.", (("row_number()", "row_number()"),))
operator("sequence_mask", "WIN5 WIN12 IMG19", "fx_region", """
select page_id, region_no, k, k < least(n_lines, 5) as used from fx_region cross join (select 0 as k union all select 1 as k union all select 2 as k union all select 3 as k union all select 4 as k) s
""", "Masks of a padded sequence.")
operator("every_nth", "WIN9", "fx_line", """
select page_id, line_no from (select page_id, line_no, row_number() over (partition by page_id order by line_no) - 1 as i, count(*) over (partition by page_id) as n from fx_line) t where floor(n / 2) < 2 or i % 2 = 0
""", "Every second point, where two or more are left.")
operator("sorted_lines", "SORT1 SORT2 SORT3 SORT4", "fx_line", """
select page_id, line_no, row_number() over (partition by page_id order by y desc, x, line_no) as by_y_x, row_number() over (partition by page_id order by x, line_no) as by_x, row_number() over (partition by page_id order by y + h, line_no) as by_bottom from fx_line
""", "Places of lines in the orders that the operators use.")
operator("article_order", "SORT5", "fx_line", """
select page_id, a, row_number() over (partition by page_id order by case when a is null then 1 else 0 end, cast(substr(a, 2) as int)) as place from (select distinct page_id, case when hyp_id <> 2 then concat('a', cast(hyp_id * 9 + 2 as varchar(10))) end as a from fx_line) t
""", "Article ids by their number, missing ones last.")
operator("top_lines", "SORT7", "fx_line", """
select page_id, line_no, w from (select *, row_number() over (partition by page_id order by w desc, line_no) as rn from fx_line) t where rn <= 3
""", "The three widest lines of a page.")
operator("even_vertices", "SET1", "fx_region", """
select page_id, x, y from (select page_id, x0 as x, y0 as y from fx_region union all select page_id, x1, y0 from fx_region union all select page_id, x1, y1 from fx_region union all select page_id, x0, y1 from fx_region) v group by page_id, x, y having count(*) % 2 = 1
""", "Vertices of a page's boxes that an odd number of boxes has.")
operator("both_directions", "SET2 SET3", "fx_edge", """
select page_id, src, dst, score from (select *, row_number() over (partition by page_id, src, dst order by f, score) as rn from (
  select page_id, src, dst, score, 0 as f from fx_edge where src < dst union all select page_id, dst as src, src as dst, score, 1 as f from fx_edge where src < dst) u where src <> dst) t where rn = 1
""", "Edges and their reverses without loops or repeats; the first feature holds.")
operator("relation_codes", "SET4 SET5", "fx_conf", """
select page_id, i, j, i * 100 + j as code, cast(floor((i * 100 + j) / 100) as bigint) as i_again, (i * 100 + j) % 100 as j_again from fx_conf
""", "Pairs as one number and back.")
operator("sampled_relations", "SET11", "fx_conf", """
select page_id, i, j, kind from (select page_id, i, j, kind, row_number() over (partition by page_id, kind order by (i * 7919 + j * 104729 + page_id) % 1009, i, j) as rn from (select page_id, i, j, case when p > 0.5 then 1 else 0 end as kind from fx_conf) k) t where rn <= 4
""", "Up to four relations of either kind by page, in a fixed pseudo-random order.")
operator("line_sets", "SET8", "fx_line", """
select page_id, cast(count(distinct gt_id) as bigint) as n_articles, cast(count(distinct case when hyp_id <> gt_id then line_no end) as bigint) as moved from fx_line group by page_id
""", "Distinct articles, and lines whose article differs.")
operator("disjoint_channels", "SET9 SET10 SET12 IMG32", "fx_line", """
select page_id, cell, min(channel) as channel from (select page_id, cast(floor(x / 100) as bigint) as cell, gt_id as channel from fx_line union all select page_id, cast(floor((x + w) / 100) as bigint) as cell, 3 as channel from fx_line) t group by page_id, cell
""", "Each cell belongs to the first channel that has it.")
operator("rounding", "FN1 FN2 FN6 FN15 FN28 FN59 FN60 IMG22", "fx_line", """
select page_id, line_no, cast(floor(w / 7.0 + 0.5) as bigint) as half_up, cast(floor(w / 10.0) as bigint) * 10 as to_base, cast(floor(x * 0.3) as bigint) as scaled, case when floor(h * 0.03) >= 1 then cast(floor(h * 0.03) as bigint) end as side, round(least(1.0, 400.0 / w), 6) as factor from fx_line
""", "Rounding, scaling and size limits.")
operator("point_distance", "FN20 FN22", "fx_line", """
select a.page_id, a.line_no as i, b.line_no as j, greatest(0, b.x - a.x, a.x - b.x - b.w) + greatest(0, b.y - a.y, a.y - b.y - b.h) as dist from fx_line a join fx_line b on a.page_id = b.page_id and a.line_no <> b.line_no
""", "City-block distance of a corner from a box.")
operator("activations", "FN52 FN53 FN54 FN55 FN56 FN57 FN58", "fx_edge", """
select page_id, src, dst, round(1 / (1 + exp(-score)), 6) as sigmoid, round(tanh(score), 6) as tanh_, greatest(0, score) as relu, greatest(0, score) + 0.2 * least(0, score) as leaky, round(case when score >= 0 then score else exp(score) - 1 end, 6) as elu, round(greatest(0, 0.5 * u0 - 0.25 * u1 + 0.1), 6) as dense from fx_edge
""", "Activations and one dense unit of given weights.")
operator("learning_rate", "FN44 FN45", "fx_page", """
select page_id, round(case when page_id < 1000 then page_id / 1000.0 when page_id < 3000 then 0.5 * (1 + cos(3.141592653589793 * (page_id - 1000) / 2000.0)) else 0.0 end, 6) as rate from fx_page
""", "Linear warm-up, then a cosine decay.")
operator("normalised_regions", "FN46 FN36 FN9 FN31 FN62 IMG9", "fx_region fx_page", """
select r.page_id, r.region_no, round(r.x0 * 1.0 / p.width, 6) as nx0, round(r.y1 * 1.0 / p.height, 6) as ny1, cast(floor(r.x0 * 0.5) as bigint) as half_x, least(r.x0, 500) as grown_x0, greatest(r.x1, 500) as grown_x1 from fx_region r join fx_page p on p.page_id = r.page_id
""", "Regions in parts of the page, halved, and grown by a point.")
operator("cluster_sizes", "ITER4 ITER11 ITER6 SINK6 ITER21", "fx_line", """
with c as (select page_id, line_no, gt_id, count(*) over (partition by page_id, gt_id) as n from fx_line), k as (select *, case when n >= 2 then gt_id else -1 end as label from c),
m as (select *, max(label) over (partition by page_id) as top from k)
select page_id, line_no, case when label >= 0 then label else top + row_number() over (partition by page_id, case when label < 0 then 1 else 0 end order by line_no) end as label from m
""", "Small clusters become noise, and each noise line a cluster of its own.")
operator("two_nodes", "ITER12 ITER22", "fx_conf", """
select page_id, max(i) as n, case when max(p) >= 0.5 then 1 else 2 end as n_clusters, 'dbscan_min1_eps0.5' as info from fx_conf group by page_id having count(*) = 2
""", "Pages of two nodes are one cluster if the confidence reaches the threshold.")
operator("symmetric_confidences", "FN32 FN33 FN34 ITER7 SINK5 IO14", "fx_conf", """
with s as (select page_id, least(i, j) as i, greatest(i, j) as j, min(p) as low, max(p) as high from fx_conf group by page_id, least(i, j), greatest(i, j))
select page_id, i, j, round(sqrt(low * high), 6) as gmean, round((low + high) / 2.0, 6) as mean, low, high, round(-ln(sqrt(low * high)), 6) as dist, round(ln(sqrt(low * high) / (1 - sqrt(low * high))), 5) as log_odds from s
""", "Both directions of a pair as one confidence, its distance and its log-odds; one pass over the relations.")
operator("regression_line", "FN17 FN18 FN19", "fx_line", """
with s as (select page_id, cast(count(*) as double) as n, cast(sum(x) as double) as sx, cast(sum(y) as double) as sy, cast(sum(x * x) as double) as sxx, cast(sum(x * y) as double) as sxy, max(x) - min(x) as width from fx_line group by page_id),
m as (select *, case when width >= 2 then (n * sxy - sx * sy) / (n * sxx - sx * sx) end as slope from s)
select page_id, round(slope, 6) as slope, round(case when width >= 2 then (sy - slope * sx) / n else sx / n end, 4) as intercept, cast(n as bigint) as n from m
""", "Least-squares slope and intercept; points within less than two pixels stand upright: no slope, and their mean x.")
TRUE_WORDS, FALSE_WORDS = "'yes', 'true', 't', 'y', '1'", "'no', 'false', 'f', 'n', '0'"
operator("booleans", "FN48 FN63", "fx_line", f"""
with w as (select case (line_no * 7 + page_id) % 11 when 0 then 'True' when 1 then 't' when 2 then '1' when 3 then 'yes' when 4 then 'Y' when 5 then 'false' when 6 then 'F' when 7 then '0' when 8 then 'No' when 9 then 'n' else 'TRUE' end as word from fx_line)
select word, lower(word) in ('true', 't', '1') as flag, case when lower(word) in ({TRUE_WORDS}) then true when lower(word) in ({FALSE_WORDS}) then false else @refuse end as argument, cast(count(*) as bigint) as n from w group by word
""", "Words as a flag (true, t, 1; all else is false) and as an argument (yes and no in five forms each; all else is refused).", (("@refuse", "cast(raise_error('not a truth value') as boolean)"),), (("@refuse", "cast(error('not a truth value') as boolean)"),))
operator("thresholded", "FILT31 FILT47", "fx_line", """
select page_id, line_no, value, case when value > 0.25 * 255 then 255 else 0 end as binary_, case when value / 255.0 > 0.25 then 1 else 0 end as above from (select page_id, line_no, (x + y * 3 + w) % 256 as value from fx_line) t
""", "Grey values against a threshold of the unit interval: 0 or 255, and 0 or 1.")
operator("typed_lists", "FILT32 FILT33", "fx_line", """
with j as (select page_id, line_no, concat('[', x, ', ', case line_no % 4 when 0 then '"a"' when 1 then '1.5' when 2 then '7' else 'true' end, ']') as text from fx_line)
select page_id, line_no, @whole as whole, @number as number from j
""", "Whether all of a list's values are of one type exactly (whole numbers), or of one of several (numbers).",
         (("@whole", "forall(cast(parse_json(text) as array<variant>), v -> schema_of_variant(v) = 'BIGINT')"), ("@number", "forall(cast(parse_json(text) as array<variant>), v -> schema_of_variant(v) = 'BIGINT' or schema_of_variant(v) like 'DECIMAL%' or schema_of_variant(v) = 'DOUBLE')")),
         (("@whole", "len(list_filter(cast(text::json as json[]), lambda v: json_type(v) not in ('UBIGINT', 'BIGINT'))) = 0"), ("@number", "len(list_filter(cast(text::json as json[]), lambda v: json_type(v) not in ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 0")))
