"""Entities of a page: lines, regions, articles, texts (projections and filters of a scan)."""

from __future__ import annotations

from .sqlop import operator

JOINED = ("joined(txt, chr(10), line_no)", "array_join(transform(sort_array(collect_list(struct(line_no, txt))), t -> t.txt), chr(10))"), ("joined(txt, chr(10), line_no)", "string_agg(txt, chr(10) order by line_no)")

operator("line_dedupe", "PROJ1 PROJ2 FILT7 PROJ45", "fx_line", """
select page_id, region_no, line_no, txt from (select *, row_number() over (partition by page_id, region_no order by line_no) as rn from fx_line) t where rn = 1
""", "First line of each id of a page, in document order.")
operator("text_regions", "PROJ3 FILT34 FILT42", "fx_region", """
select page_id, region_no, coalesce(region_type, 'paragraph') as region_type, n_lines from fx_region
""", "Text regions with their type; a missing type is a paragraph.")
operator("heading_lines", "FILT34 FILT35 FILT36 FILT6 FILT41", "fx_line fx_region", """
select l.page_id, l.line_no, l.txt from fx_line l join fx_region r on l.page_id = r.page_id and l.region_no = r.region_no where r.region_type = 'heading'
""", "Lines of heading regions.")
operator("region_kinds", "PROJ4 AGG18 PROJ42 FILT5 FILT37 FILT38 FILT39 FILT40 FILT45", "fx_region fx_sep fx_line", """
select page_id, kind, cast(count(*) as bigint) as n from (
  select page_id, 'TextRegion' as kind from fx_region union all select page_id, 'SeparatorRegion' as kind from fx_sep union all select page_id, 'TextLine' as kind from fx_line
  union all select page_id, 'Article' as kind from (select distinct page_id, nullif(gt_id, 2) as a from fx_line) d) k group by page_id, kind
""", "Counts of every kind of entity by page; lines without an article count as one.")
operator("unique_id", "PROJ7 PROJ8", "fx_region", """
select page_id, case when min(region_no) > 1 then 1 else min(case when nxt is null or nxt > region_no + 1 then region_no + 1 end) end as free_id
from (select page_id, region_no, lead(region_no) over (partition by page_id order by region_no) as nxt from fx_region) t group by page_id
""", "The least number from 1 that is no region id of the page.")
operator("article_dict", "PROJ9 PROJ46 PROJ47 FILT32 WIN10", "fx_line", """
select page_id, nullif(gt_id, 2) as article_id, cast(count(*) as bigint) as n_lines, min(line_no) as first_line, max(x + w) as right_end from fx_line where w >= 2 group by page_id, nullif(gt_id, 2)
""", "Lines by article; no article is a group.")
operator("region_text", "PROJ5 PROJ6 PROJ36 PROJ40 SINK13 JOIN23", "fx_line", """
select page_id, region_no, joined(txt, chr(10), line_no) as text from fx_line group by page_id, region_no
""", "Text of a region: its lines by line breaks.", (JOINED[0],), (JOINED[1],))
operator("article_text", "SINK14 SINK15", "fx_line", """
select page_id, gt_id as article_id, joined(txt, chr(10), line_no) as text, cast(count(*) as bigint) as n_lines from fx_line where txt <> '' group by page_id, gt_id
""", "Text of an article: its non-empty lines.", (JOINED[0],), (JOINED[1],))
operator("majority_article", "JOIN5 SINK12 FILT10", "fx_line", """
select page_id, region_no, article_id, n from (
  select page_id, region_no, article_id, n, row_number() over (partition by page_id, region_no order by n desc, article_id) as rn
  from (select page_id, region_no, nullif(gt_id, 2) as article_id, cast(count(*) as bigint) as n from fx_line where gt_id <> 2 group by page_id, region_no, nullif(gt_id, 2)) c) r where rn = 1
""", "The article of most lines of a region; missing ids don't vote, ties go to the least id.")
operator("region_upsert", "PROJ39 PROJ41 PROJ53 PROJ54 PROJ55 SINK23 IO2 SINK19", "fx_region fx_sep", """
with new as (select page_id, 2 as region_no, x0, y0 from fx_sep)
select page_id, region_no, x0, y0 from fx_region where not exists (select 1 from new where new.page_id = fx_region.page_id and new.region_no = fx_region.region_no) union all select page_id, region_no, x0, y0 from new
""", "Inserts regions by id; those already there are replaced.")
operator("page_defaults", "IO5 IO6 IO27 FN29", "fx_page fx_region", """
select p.page_id, p.width, p.height, coalesce(greatest(min(r.x0), 0), 0) as left_, coalesce(greatest(min(r.y0), 0), 0) as top_, coalesce(max(r.x1), p.width) as right_, coalesce(max(r.y1), p.height) as bottom_
from fx_page p left join fx_region r on r.page_id = p.page_id group by p.page_id, p.width, p.height
""", "Resolution and print space; negative corners are clamped, without regions it is the whole image.")
operator("discard_small_regions", "FILT1 FILT9", "fx_region fx_line", """
with r as (select page_id, region_no, n_lines, cast(floor((x1 - x0) / 40) as bigint) + 1 as width, cast(floor((y1 - y0) / 3) as bigint) + 1 as height from fx_region)
select l.page_id, l.line_no from fx_line l join r on l.page_id = r.page_id and l.region_no = r.region_no where r.n_lines > 0 and r.width >= 10 and r.height >= 10
""", "Lines of regions that have lines and are ten pixels or more on both sides, the last one counted (here: of scaled boxes).")
operator("border_lines", "FILT8", "fx_line fx_page", """
select page_id, line_no from (select l.page_id, l.line_no, l.x, l.w, p.width, avg(l.w) over (partition by l.page_id) as mean_w from fx_line l join fx_page p on l.page_id = p.page_id) t
where not ((x < 80 or x + w > width - 80) and w < mean_w / 2.0)
""", "Lines but for short ones at the page's left or right border.")
operator("component_filter", "FILT2 FILT3", "fx_line", """
select page_id, line_no, w, h from fx_line where w between 3 and 500 and h between 3 and 500 and greatest(w, h) <= 8 * least(w, h)
""", "Components of plausible size and aspect.")
operator("text_regions_off_images", "FILT4 FILT43", "fx_region fx_sep", """
with i as (select page_id, x0, y0, x0 + 300 as x1, y0 + 60 as y1 from fx_sep)
select r.page_id, r.region_no from fx_region r where coalesce(r.region_type, 'paragraph') = 'paragraph' and not exists (select 1 from i where i.page_id = r.page_id
  and ((least(r.x1, i.x1) + 1 - greatest(r.x0, i.x0) > 20 and least(r.y1, i.y1) + 1 - greatest(r.y0, i.y0) > 20) or (r.x0 > i.x0 and r.x1 < i.x1 and r.y0 > i.y0 and r.y1 < i.y1)))
""", "Paragraphs that lie in no image's box and share no more than 20 pixels on both axes with one.")
operator("paths", "IO17 IO19 IO20 IO21 IO22 IO23 IO24 IO25 PROJ44 SINK18 SINK20 SINK25", "fx_page", """
select page_id, concat('/data/set1/page/', 'p', page_id, '.xml') as page_path, regexp_replace(concat('/data/set1/page/', 'p', page_id, '.xml'), '/page/([^/]*)[.]xml$', @1) as image_path,
  regexp_replace(concat('/data/set1/jsonf2/', 'p', page_id, '.json'), '/json[a-z0-9]*/([^/]*)[.]json$', @2) as from_json, regexp_replace(concat('/data/set1/confidences/p', page_id, '_confidences.json'), '/confidences/([^/]*)_confidences[.]json$', @2) as from_conf,
  concat(regexp_extract(concat('/data/set1/p', page_id), '([^/]*)/[^/]*$', 1), '_', regexp_extract(concat('/data/set1/p', page_id), '([^/]*)$', 1)) as prefixed, method like 'm%' and method not like '%3%' as used from fx_page
""", "Paths of images, pages, graphs and confidences out of one another.", (("@1", "'/$1.jpg'"), ("@2", "'/page/$1.xml'")), (("@1", "'/\\1.jpg'"), ("@2", "'/page/\\1.xml'")))
operator("image_of_page", "IO18 IO19", "fx_page", """
with f as (select concat('/data/set1/p', page_id, '.tif') as path from fx_page where page_id % 5 = 0 union all select concat('/data/set1/p', page_id, '.png') as path from fx_page where page_id % 3 = 0 union all select concat('/data/set1/p', page_id, '.jpg') as path from fx_page where page_id % 2 = 0),
p as (select page_id, concat('/data/set1/page/p', page_id, '.xml') as page_path from fx_page)
select p.page_id, t.stem_path as image_path, t.stem_path is null as missing from p left join (
  select stem, min_by(path, rank) as stem_path from (select path, substr(path, 1, length(path) - 4) as stem, case substr(path, -3) when 'tif' then 0 when 'png' then 1 else 2 end as rank from f) r group by stem) t
on t.stem = regexp_replace(p.page_path, '/page/([^/]*)[.]xml$', @1)
""", "A page's image among the files that are there: tif before png before jpg.", (("@1", "'/$1'"),), (("@1", "'/\\1'"),))
