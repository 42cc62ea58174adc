"""The queries of the catalogue as SQL over the same tables.

Written from the meaning of each operator, with plain windows, lists or recursion; nothing
here follows how the Spark side splits the work.
"""

from __future__ import annotations

from kilnflow.constants import COMPONENT_MODES, COMPONENT_ORDER, MODELS, SPACE, STAGE_OF_COMPONENT
from kilnflow.plans.catalog import AUDIT_NEEDED, AUDIT_TITLES

FEEDS = {
    "timing_log": """
        select user_id as session_id, event_id,
               row_number() over (partition by user_id order by ts, event_id) as seq,
               value as elapsed_s from events""",
    "component_events": """
        select user_id as run_id, concat('c', cast(event_id % 4 as varchar)) as component,
               case when event_type in ('view', 'click') then 'start'
                    when event_type = 'signup' then 'reset' else 'end' end as kind,
               ts, event_id as seq from events""",
    "component_times": """
        select user_id as run_id,
               case event_type when 'view' then 'input' when 'click' then 'text-encode'
                    when 'signup' then 'diffusion' when 'purchase' then 'vae-decode'
                    else 'other' end as component,
               value as elapsed_s, event_id as seq from events""",
    "state_events": """
        select user_id as run_id, ts, event_id as seq,
               case event_type when 'view' then 'input' when 'click' then 'encoding'
                    when 'signup' then 'diffusion' when 'purchase' then 'complete'
                    else 'idle' end as component,
               cast(event_id % 31 as integer) as progress,
               case when event_id % 7 = 0 then 0 else 30 end as total,
               case when event_type = 'error' then concat('Error: ', props)
                    else event_type end as message,
               value / 10 as time_per_step from events""",
    "requests": """
        select p_partkey as request_id,
               case when p_partkey % 11 = 0 then '  ' else p_name end as prompt,
               case when p_partkey % 7 = 0 then null
                    else p_size * 8 + cast(p_partkey % 2 as integer) end as width,
               case when p_partkey % 5 = 0 then 0 else p_size * 16 end as height,
               p_size as num_inference_steps, p_partkey % 3 as seed,
               case when p_partkey % 13 = 0 then 'brushnet' else 'flux' end as model
        from part""",
    "step_log": """
        select l_orderkey as run_id, l_linenumber as item, l_partkey, l_suppkey,
               l_quantity as steps, l_extendedprice / 1000 as elapsed_s from lineitem""",
    "assets": """
        select concat('order_', cast(o_orderkey as varchar), '.png') as path,
               o_orderdate as mtime, cast(floor(o_totalprice) as bigint) as length,
               o_orderkey % 3 <> 0 as was_there from orders""",
    "prompts": "select doc_id as prompt_id, lang as mode, text from documents",
    "vector_pairs": """
        select a.vec_id as pair_id, a.embedding as u, b.embedding as t
        from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0""",
    "edit_log": """
        select user_id as image_id, event_id as seq,
               row_number() over (partition by user_id order by event_id) as step,
               case event_type when 'error' then 'reset' when 'click' then 'undo'
                    else 'add' end as op,
               value as x1, event_id % 97 * 1.0e0 as y1, value + 10 as x2,
               event_id % 97 * 1.0e0 - 5 as y2 from events""",
    "points": """
        select l_orderkey as point_id, l_linenumber as line, l_quantity as x,
               (l_partkey % 100) * 1.0e0 as y from lineitem""",
    "calls": """
        select p_partkey as call_id,
               case p_partkey % 3 when 0 then 'generate_image' when 1 then 'generate_images_batch'
                    else 'other' end as name,
               case p_partkey % 3
                    when 1 then concat('{"prompts":["', p_name, '","', p_brand, '"]}')
                    else concat('{"prompt":"', p_name, '","seed":', cast(p_size as varchar), '}')
               end as arguments from part""",
}

# Feeds and steps that build on others, in order.
STEPS = {
    "baselines": """
        select session_id, case when count(*) = 3 then median(elapsed_s) end as b
        from timing_log where seq <= 3 group by session_id""",
    "thermal": """
        select l.session_id, l.event_id, l.seq, l.elapsed_s, b,
               avg(elapsed_s) over upto as m, max(elapsed_s) over upto as mx,
               list(elapsed_s) over upto as recent,
               b / avg(elapsed_s) over upto as ratio,
               case when l.seq > 3 then max(elapsed_s) over ahead / b end as slowdown
        from timing_log l join baselines using (session_id)
        window upto as (partition by l.session_id order by l.seq
                        rows between 4 preceding and current row),
               ahead as (partition by l.session_id order by l.seq
                         rows between 5 preceding and 1 preceding)""",
    "flags": """
        select session_id, event_id, seq, elapsed_s, coalesce(slowdown >= 1.5, false) as flag
        from thermal""",
    "plan": """
        select session_id, event_id, seq, flag, false as boundary, cast(1 as bigint) as since
        from flags where seq = 1
        union all
        select f.session_id, f.event_id, f.seq, f.flag, p.since >= 10,
               case when f.flag or p.since >= 10 then 1 else p.since + 1 end
        from plan p join flags f on f.session_id = p.session_id and f.seq = p.seq + 1""",
    "flags_high": """
        select session_id, event_id, seq,
               coalesce(max(elapsed_s) over (partition by session_id order by seq
                        rows between 5 preceding and 1 preceding) / 120.0 >= 1.3, false) as flag
        from timing_log""",
    "plan_high": """
        select session_id, event_id, seq, flag, false as boundary, cast(1 as bigint) as since
        from flags_high where seq = 1
        union all
        select f.session_id, f.event_id, f.seq, f.flag, p.since >= 5,
               case when f.flag or p.since >= 5 then 1 else p.since + 1 end
        from plan_high p join flags_high f on f.session_id = p.session_id and f.seq = p.seq + 1""",
    "segments": """
        select *, sum(case when kind = 'reset' then 1 else 0 end)
                  over (partition by run_id order by ts, seq rows unbounded preceding) as segment
        from component_events""",
    "stacks": """
        select image_id, step,
               case op when 'add' then [seq] else cast([] as bigint[]) end as stack
        from edit_log where step = 1
        union all
        select e.image_id, e.step,
               case e.op when 'reset' then cast([] as bigint[])
                         when 'undo' then s.stack[1 : len(s.stack) - 1]
                         else list_append(s.stack, e.seq) end
        from stacks s join edit_log e on e.image_id = s.image_id and e.step = s.step + 1""",
    "last_stacks": """
        select image_id, arg_max(stack, step) as stack from stacks group by image_id""",
    "rects": """
        select l.image_id, l.seq, l.rect_id, least(e.x1, e.x2) as x1, least(e.y1, e.y2) as y1,
               greatest(e.x1, e.x2) as x2, greatest(e.y1, e.y2) as y2
        from (select image_id, unnest(stack) as seq,
                     unnest(range(1, len(stack) + 1)) as rect_id from last_stacks) l
        join edit_log e on e.image_id = l.image_id and e.seq = l.seq""",
    "latest_times": """
        select run_id, component, arg_max(elapsed_s, seq) as elapsed_s
        from component_times group by run_id, component""",
    "slugs": f"""
        select prompt_id,
               coalesce(nullif(replace(trim(regexp_replace(substring(text, 1, 50),
                   '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), ' ', '_'), ''), 'generated_image') as slug
        from prompts""",
}
NEEDS = {
    "baselines": ["timing_log"],
    "thermal": ["timing_log", "baselines"],
    "flags": ["thermal"],
    "plan": ["flags"],
    "flags_high": ["timing_log"],
    "plan_high": ["flags_high"],
    "segments": ["component_events"],
    "stacks": ["edit_log"],
    "last_stacks": ["stacks"],
    "rects": ["last_stacks", "edit_log"],
    "latest_times": ["component_times"],
    "slugs": ["prompts"],
}


def _with(*names: str) -> str:
    """The ``with`` clause for these feeds and steps and all they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({FEEDS.get(n) or STEPS.get(n)})" for n in wanted]
    return "with recursive " + ",\n".join(parts) + "\n"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '[{SPACE}]+'), lambda w: w <> '')"


def _slug(column: str, n: int) -> str:
    return (
        f"coalesce(nullif(replace(trim(regexp_replace(substring({column}, 1, {n}), "
        r"'[^\p{L}\p{N} _-]', '', 'g')), ' ', '_'), ''), 'generated_image')"
    )


def _key(column: str) -> str:
    kept = rf"regexp_replace({column}, '[^\p{{L}}\p{{N}}_{SPACE}-]', '', 'g')"
    return f"replace({_strip(kept)}, ' ', '_')"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


NAMES = ", ".join(f"''{n}''" for n in MODELS)
STAGES = " ".join(f"when '{c}' then '{s}'" for c, s in STAGE_OF_COMPONENT.items())
ORDER = "[" + _quoted(COMPONENT_ORDER) + "]"
MODEL_ROWS = ", ".join(
    "('{}', '{}', {}, {}, {}, {}, {})".format(
        name,
        m["model_id"],
        str(m["keep_loaded"]).lower(),
        "null::integer" if m["idle_timeout"] is None else m["idle_timeout"],
        m["default_steps"],
        "null::integer" if m["default_size"] is None else m["default_size"][0],
        "null::integer" if m["default_size"] is None else m["default_size"][1],
    )
    for name, m in MODELS.items()
)
MODEL_CTE = (
    "models(model, model_id, keep_loaded, idle_timeout, default_steps, dh, dw) "
    f"as (values {MODEL_ROWS})"
)
COMPONENT_CTE = "components(component, modes) as (values {})".format(
    ", ".join(f"('{c}', '{m}')" for c, m in COMPONENT_MODES.items())
)
RESOLVED = (
    _with("requests")
    + f", {MODEL_CTE}, resolved as (select request_id, "
    "coalesce(nullif(height, 0), dh) as height, coalesce(nullif(width, 0), dw) as width, "
    "coalesce(nullif(num_inference_steps, 0), default_steps) as num_inference_steps, seed "
    "from requests join models using (model)) "
)
ETA = """
    case when total > 0 and progress > 0 and time_per_step <> 0
         then (total - progress) * time_per_step end"""
ETA_TEXT = """
    case when remaining > 60
         then concat(cast(cast(floor(remaining / 60) as bigint) as varchar), 'm ',
                     cast(cast(floor(remaining % 60) as bigint) as varchar), 's')
         when remaining is not null
         then concat(cast(cast(floor(remaining) as bigint) as varchar), 's') end"""
PERCENT = "case when total > 0 then progress / total * 100 else 100.0 end"
TIME = "'%Y-%m-%d %H:%M:%S'"
NUMBER = "cast(json_extract(arguments, '$.{}') as {})"
JOINED = "array_to_string(cast(json_extract(arguments, '$.prompts') as varchar[]), '|')"

SQL: dict[str, str] = {}

SQL["S1_read_prompts"] = f"""
    select prompt from (
        select {_strip('line')} as prompt from (
            select unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) as line from documents))
    where prompt <> ''"""

SQL["S2_read_requests"] = _with("calls") + f"""
    select call_id, json_extract_string(arguments, '$.prompt') as prompt,
           {NUMBER.format('seed', 'bigint')} as seed, cast(null as integer) as num_inference_steps,
           false as return_base64,
           case when json_extract(arguments, '$.prompt') is null
                then 'prompt: field required' end as request_error
    from calls"""

SQL["S2_read_request_files"] = _with("requests") + """
    select case when seed <> 1 then prompt end as prompt, coalesce(width, 1024) as width,
           coalesce(height, 1024) as height,
           coalesce(num_inference_steps, 30) as num_inference_steps, request_id as seed,
           'text2img' as mode, 7.5e0 as guidance_scale, 0.8e0 as strength,
           case when seed = 1 then 'prompt: field required' end as request_error
    from requests"""

SQL["S3_asset_catalog"] = _with("assets") + """
    select path, length, round(length / 1048576.0e0, 6) as size_mb from assets"""

SQL["S4_image_dimensions"] = _with("requests") + """
    select request_id,
           case when request_id % 10 <> 9 then cast(coalesce(width, 0) as bigint) end as width,
           case when request_id % 10 <> 9 then cast(height as bigint) end as height
    from requests"""

SQL["S5_session_layout"] = f"""
    select doc_id, concat({_key("concat(source, ': ', lang)")}, '_20251018') as session_key,
           case doc_id % 3 when 0 then 'images' when 1 then 'data' else 'root' end as kind
    from documents"""

SQL["S6_payload_round_trip"] = _with("prompts") + """
    select prompt_id, base64(encode(text)) as encoded, text as decoded from prompts"""

SQL["S7_read_state_events"] = _with("state_events") + """
    select run_id, seq, component, progress, total, message, epoch_us(ts) as ts_micros,
           case when total > 0 then 1 else 0 end as metrics,
           case when total > 0 then round(time_per_step, 6) end as time_per_step
    from state_events"""

SQL["S7_stream_state_events"] = SQL["S7_read_state_events"]

SQL["S3_read_asset_catalog"] = """
    select source, sum(octet_length(encode(lang)) + length(doc_id::varchar) + 1)::bigint as length,
           true as dated, round(sum(octet_length(encode(lang)) + length(doc_id::varchar) + 1) / 1048576.0, 6) as size_mb
    from documents group by source"""

SQL["S8_write_results"] = _with("requests") + f"""
    , checked as (
        select *, case when model <> 'flux' then concat('Model not available: ', model)
                       when trim(prompt) = '' then 'Prompt cannot be empty' end as error
        from requests)
    select request_id, error is null as success,
           coalesce(error, 'Image generated successfully') as message,
           case when error is null then concat({_slug('prompt', 50)}, '.png') end as image_path,
           case when error is null then width end as width,
           case when error is null then height end as height,
           case when error is null then seed end as seed
    from checked"""

SQL["S8_batch_results"] = _with("requests") + f"""
    , outcomes as (
        select cast(floor(request_id / 10) as bigint) as batch_id, request_id as position,
               concat({_slug('prompt', 50)}, '.png') as image_path,
               case when request_id % 3 <> 0 then null
                    when model <> 'flux' then concat('Model not available: ', model)
                    when trim(prompt) = '' then 'Prompt cannot be empty' end as error
        from requests)
    , there as (select distinct image_path from outcomes where position % 7 = 0)
    , fresh as (select batch_id, image_path, min(position) as position from outcomes
                where image_path not in (select image_path from there) group by all)
    , paths as (select batch_id, string_agg(image_path, '|' order by position) as paths
                from fresh group by batch_id)
    , batches as (select batch_id, arg_min(error, position) filter (error is not null) as error,
                         count(*) as made from outcomes group by batch_id)
    select b.batch_id, error is null as success,
           coalesce(error, concat('Generated ', cast(made as varchar), ' images successfully')) as message,
           case when error is null then coalesce(paths, '') else '' end as image_paths,
           case when error is null then made else 0 end as count
    from batches b left join paths p on b.batch_id = p.batch_id"""

SQL["P1_resolve_defaults"] = RESOLVED + """
    select request_id, height, width, num_inference_steps, seed, seed is not null as seeded
    from resolved"""

SQL["P2_validate_requests"] = _with("requests") + """
    select request_id,
           array_to_string(list_filter([
               case when model <> 'flux' then concat('Model not available: ', model) end,
               case when trim(prompt) = '' then 'Prompt cannot be empty' end],
               lambda x: x is not null), '; ') as reasons,
           case when height % 8 <> 0 or width % 8 <> 0
                then 'Height and width should be multiples of 8' else '' end as warnings,
           model = 'flux' and trim(prompt) <> '' as accepted
    from requests"""

SQL["P3_route_mode"] = """
    with asked as (
        select event_id as request_id, (event_id % 10) / 10 as strength,
               coalesce(case event_type when 'view' then 'text2img' when 'click' then 'img2img'
                        when 'purchase' then 'controlnet' when 'error' then 'upscale' end,
                        'text2img') as mode,
               event_id % 2 = 0 and props is not null as has_image
        from events)
    select request_id,
           case when mode in ('img2img', 'controlnet') and not has_image then 'text2img'
                else mode end as effective_mode,
           case mode when 'text2img' then 'Text-to-Image (generate from scratch)'
                when 'img2img' then concat(
                    'Image-to-Image (transform existing image, strength=',
                    cast(cast(strength as double) as varchar), ')')
                when 'controlnet' then 'ControlNet (structure-guided generation)'
                else 'text2img' end as mode_description,
           case when mode not in ('img2img', 'controlnet') then ''
                when has_image then 'Reference image received (base64 encoded)'
                else 'WARNING: No reference image provided, falling back to text2img'
           end as mode_note
    from asked"""

SQL["P4_route_pipeline"] = """
    select p_partkey, case when p_partkey % 4 = 0 then 'flux' else 'sdxl' end as pipeline,
           case when p_partkey % 4 <> 0 then
                round(case when p_partkey % 3 <> 0 then p_size / 10.0e0 else 7.5e0 end, 6)
           end as guidance
    from part"""

SQL["P5_derive_shapes"] = RESOLVED + """
    select request_id, cast(height // 8 as integer) as latent_height,
           cast(width // 8 as integer) as latent_width, 4 as channels from resolved"""

SQL["P6_prompt_preview"] = _with("prompts") + """
    select prompt_id, concat(substring(text, 1, 50), '...') as preview from prompts"""

SQL["P7_completed_stages"] = _with("component_times") + f"""
    select seq, component,
           cast(coalesce(list_position({ORDER}, component), 0) - 1 as integer) as stage_index,
           array_to_string({ORDER}[1 : coalesce(list_position({ORDER}, component), 1) - 1], ',')
               as stages_done
    from component_times"""

SQL["P8_throughput"] = _with("step_log") + """
    , log as (
        select run_id, item, l_partkey, l_suppkey,
               case when l_partkey % 9 = 0 then 0.0e0 else elapsed_s end as elapsed_s,
               case when l_partkey % 8 = 0 then 0.0e0 else steps end as steps from step_log)
    select run_id, item, l_partkey, l_suppkey,
           case when elapsed_s > 0 then round(steps / elapsed_s, 10) else 0.0e0 end as steps_per_s,
           case when steps <> 0 then round(elapsed_s / steps, 10) end as s_per_step,
           case when steps <> 0 then round(elapsed_s / steps * 1000, 10) end as ms_per_step
    from log"""

SQL["P9_progress_eta"] = _with("step_log") + f"""
    , log as (
        select run_id, item, l_partkey, l_suppkey, l_partkey % 51 as progress,
               case when l_suppkey % 10 = 0 then 0 else 50 end as total,
               case when item <> 7 then elapsed_s / 10 end as time_per_step from step_log)
    , timed as (select *, {PERCENT} as percent, {ETA} as remaining from log)
    select run_id, item, l_partkey, l_suppkey, round(percent, 6) as percent,
           round(remaining, 6) as remaining_s, {ETA_TEXT} as remaining from timed"""

SQL["P10_sample_every_n"] = """
    select * from (
        select user_id, event_id,
               row_number() over (partition by user_id order by ts, event_id) - 1 as step_index
        from events) where step_index % 5 = 0"""

SQL["P11_parse_size"] = """
    select p_partkey, case when p_partkey % 6 <> 0 then p_size * 8 end as width,
           case when p_partkey % 6 <> 0 then cast(p_partkey as integer) end as height
    from part"""

SQL["P12_dispatch_calls"] = _with("calls") + f"""
    select call_id, name,
           case name when 'generate_image' then json_extract_string(arguments, '$.prompt')
                     when 'generate_images_batch' then {JOINED} end as prompts,
           case when name = 'generate_image' then 1024 end as width,
           case when name = 'generate_image' then 1024 end as height,
           case when name <> 'other' then 30 end as num_inference_steps,
           case when name = 'generate_image' then {NUMBER.format('seed', 'bigint')} end as seed,
           name <> 'other' as success,
           case when name = 'other' then 'Unknown function: other' end as error
    from calls"""

SQL["P13_throttle_label"] = _with("thermal") + """
    select session_id, event_id,
           case when seq < 3 or b is null then 'Establishing baseline...'
                else concat('Performance: ',
                            cast(cast(round_even(ratio * 100, 0) as bigint) as varchar), '%')
           end as performance,
           case when seq >= 3 and ratio < 1.0 / 1.5e0 then 'THROTTLED' else 'NORMAL' end as status
    from thermal"""

SQL["J1_lookup_model"] = _with("requests") + f"""
    , {MODEL_CTE}, asked as (
        select request_id,
               case when request_id % 17 = 0 then 'dalle' else model end as model from requests)
    select request_id, a.model, model_id, default_steps, dh as default_height,
           coalesce(keep_loaded, false) as keep_loaded, idle_timeout,
           case when model_id is null
                then concat('Unknown model: ', a.model, '. Available: [{NAMES}]') end as model_error
    from asked a left join models m on a.model = m.model"""

ASKED_MODES = """
    asked as (
        select event_id as request_id,
               ['text2img', 'img2img', 'llm', 'audio2text', 'upscale'][event_id % 5 + 1] as mode
        from events)"""

SQL["J2_active_components"] = f"""
    with {COMPONENT_CTE}, {ASKED_MODES}, modes as (
        select mode, count(*) as requests from asked group by mode)
    select mode, component,
           list_contains(string_split(modes, ','), 'all')
               or list_contains(string_split(modes, ','), mode) as is_active, requests
    from modes cross join components"""

SQL["J2_dimmed_rows"] = f"""
    with {COMPONENT_CTE}, {ASKED_MODES}
    select request_id, string_split(component, '-')[1] as row
    from asked cross join components group by 1, 2
    having not bool_or(list_contains(string_split(modes, ','), 'all')
                       or list_contains(string_split(modes, ','), mode))"""

SQL["J3_map_stage"] = _with("component_times") + f"""
    select * from (select run_id, seq, component, case component {STAGES} end as stage
                   from component_times) where stage is not null"""

SQL["J4_zip_by_position"] = """
    select position, doc_id, item_id, text
    from (select doc_id, row_number() over (order by n_chars, doc_id) as position from documents)
    join (select item_id, text, row_number() over (order by item_id) as position from benchmark)
    using (position)"""

SQL["J5_region_mask"] = _with("rects", "points") + """
    select x, y, point_id, line, 255 as mask from points p
    where exists (select 1 from rects r
                  where p.x between r.x1 and r.x2 and p.y between r.y1 and r.y2)"""

SQL["J5_region_mask_per_image"] = _with("rects", "points") + """
    select x, y, point_id, line, point_id % 100 as image_id, 255 as mask from points p
    where exists (select 1 from rects r where r.image_id = p.point_id % 100
                  and p.x between r.x1 and r.x2 and p.y between r.y1 and r.y2)"""

SQL["J6_sweep"] = """
    select p_partkey, p_name as prompt, steps, seed
    from part cross join (select unnest([5, 10, 15, 20, 25, 30, 35, 40, 45, 50]) as steps)
    cross join (select unnest([42, 43]) as seed)"""

SQL["J7_apply_overrides"] = _with("requests") + """
    , over as (
        select case when request_id % 8 = 0 then request_id + 10000000 else request_id end
                   as request_id,
               cast(null as integer) as width, height + 1 as height, 'local' as model
        from requests where request_id % 4 = 0)
    select request_id, width, height, model from over
    union all
    select request_id, width, height, model from requests
    where request_id not in (select request_id from over)"""

SQL["A1_component_share"] = _with("latest_times") + """
    select run_id, component, round(elapsed_s, 6) as elapsed_s,
           round(elapsed_s / total * 100, 6) as percent
    from (select *, sum(elapsed_s) over (partition by run_id) as total from latest_times)
    where total <> 0"""

PAIRED = """
    , paired as (
        select *, max(case when kind = 'start' then ts end)
                  over (partition by run_id, segment, component order by ts, seq
                        rows unbounded preceding) as started from segments)
    , ended as (
        select run_id, segment, component, ts, seq,
               coalesce((epoch_us(ts) - epoch_us(started)) / 1e6, 0.0e0) as elapsed_s,
               started is not null as matched
        from paired where kind = 'end')"""

SQL["A1_component_share_from_events"] = _with("segments") + PAIRED + """
    , latest as (select run_id, segment, component, arg_max(elapsed_s, seq) as elapsed_s
                 from ended where matched group by 1, 2, 3)
    , shared as (select *, sum(elapsed_s) over (partition by run_id, segment) as total from latest)
    select run_id, cast(segment as bigint) as segment, component,
           round(elapsed_s, 6) as elapsed_s, round(elapsed_s / total * 100, 6) as percent
    from shared where total <> 0"""

SQL["A2_stage_breakdown"] = _with("latest_times") + f"""
    , totals as (select run_id, sum(elapsed_s) as total from latest_times
                 where run_id % 2 = 0 group by run_id)
    , runs as (select distinct run_id from latest_times)
    , stages as (select unnest(['stageInput', 'stageEncoding', 'stageProcessing',
                                'stageDecoding', 'stageOutput']) as stage)
    , summed as (select run_id, case component {STAGES} end as stage, sum(elapsed_s) as s
                 from latest_times group by 1, 2)
    select run_id, stage, round(coalesce(s, 0), 6) as stage_s,
           round(coalesce(s, 0) / coalesce(nullif(total, 0), 1) * 100, 6) as percent
    from runs cross join stages left join summed using (run_id, stage)
    left join totals using (run_id)"""

SQL["A3_timing_stats"] = _with("plan") + """
    select t.session_id, count(*) as generations, round(avg(elapsed_s), 8) as avg_s,
           round(min(elapsed_s), 6) as min_s, round(max(elapsed_s), 6) as max_s,
           round(any_value(b), 6) as baseline,
           round(arg_max(case when b is not null then ratio end, t.seq), 6) as current_ratio,
           coalesce(arg_max(ratio, t.seq) < 1.0 / 1.5e0, false) as currently_throttled,
           cast(sum(case when p.flag or boundary then 1 else 0 end) as bigint) as breaks_taken,
           cast(sum(case when boundary then 60 when p.flag then 30 else 0 end) as bigint)
               as total_cooling_s
    from thermal t join plan p on t.session_id = p.session_id and t.seq = p.seq
    group by t.session_id"""

SQL["A4_learn_baseline"] = _with("baselines") + """
    select session_id, round(b, 6) as baseline from baselines"""

SQL["A4_learn_baseline_window_2"] = _with("timing_log") + """
    select session_id, round(case when max(seq) >= 3 then
               avg(case when seq in (2, 3) then elapsed_s end) end, 6) as baseline
    from timing_log group by session_id"""

SQL["A5_session_efficiency"] = _with("step_log") + """
    , sums as (select run_id, sum(elapsed_s) as a, sum(steps) * 1.5e0 as i
               from step_log group by run_id)
    select run_id, round(a, 6) as actual_s, round(i, 6) as ideal_s, round(a - i, 6) as wasted_s,
           round((a - i) / a * 100, 6) as loss_pct from sums"""

SQL["A6_batch_summary"] = _with("step_log") + """
    select run_id, count(*) as items, round(sum(elapsed_s), 6) as total_s,
           round(sum(elapsed_s) / count(*), 8) as mean_s from step_log group by run_id"""

SQL["A7_phase_profile"] = _with("step_log") + """
    , phased as (
        select elapsed_s / (steps * 2) as rate,
               case when steps * 2 between 5 and 60 then 'normal'
                    when steps * 2 between 65 and 75 then 'throttled'
                    when steps * 2 >= 80 then 'recovered' end as phase from step_log)
    select phase, count(*) as items, round(min(rate), 6) as min_s_per_step,
           round(max(rate), 6) as max_s_per_step
    from phased where phase is not null group by phase"""

SQL["A8_pixel_diff"] = _with("vector_pairs") + """
    , cells as (
        select pair_id, unnest(u) as a, unnest(case when pair_id % 10 = 0 then u else t end) as b
        from vector_pairs)
    select pair_id,
           round(sum(case when floor(a * 8) <> floor(b * 8) then 1 else 0 end) * 100.0e0
                 / count(*), 6) as percent,
           sum(case when floor(a * 8) <> floor(b * 8) then 1 else 0 end) = 0 as equal
    from cells group by pair_id"""

SQL["A9_content_audit"] = """
    select page_id, cast(len(string_split(html, '<p>')) - 1 as integer) as marker_count,
           array_to_string(list_filter([{titles}], lambda t: not contains(html, t)), '|')
               as missing_titles,
           cast(len(list_filter([{titles}], lambda t: contains(html, t))) as integer)
               as found_titles,
           {needed} as passed
    from pages""".format(
    titles=_quoted(AUDIT_TITLES),
    needed=" and ".join(f"contains(html, '{n}')" for n in AUDIT_NEEDED),
)

SQL["A9_title_report"] = f"""
    select page_id, title, contains(html, title) as found
    from pages cross join (select unnest([{_quoted(AUDIT_TITLES)}]) as title)"""

SQL["W1_rolling_state"] = _with("thermal") + """
    select session_id, event_id, seq,
           case when seq >= 3 then round(b, 6) end as baseline,
           case when seq >= 3 then round(m, 6) end as recent_mean,
           case when seq >= 3 then round(mx, 6) end as recent_max,
           case when seq >= 3 then array_to_string(list_transform(recent,
               lambda x: cast(cast(round(x * 100) as bigint) as varchar)), ',')
           end as recent_cents,
           case when seq >= 3 then round(ratio, 6) end as performance_ratio,
           case when seq >= 3 then ratio < 1.0 / 1.5e0 end as is_throttled
    from thermal"""

SQL["W2_needs_break"] = _with("thermal") + """
    select session_id, event_id, seq, round(slowdown, 6) as slowdown_before,
           coalesce(slowdown >= 1.5, false) as needs_break from thermal"""

SQL["W2_needs_break_given_baseline"] = _with("timing_log") + """
    , slow as (
        select session_id, event_id, seq,
               max(elapsed_s) over (partition by session_id order by seq
                                    rows between 5 preceding and 1 preceding) / 45.0e0 as s
        from timing_log)
    select session_id, event_id, seq, round(s, 6) as slowdown_before,
           coalesce(s >= 1.3, false) as needs_break from slow"""

SQL["W3_break_schedule"] = _with("plan") + """
    select session_id, event_id, seq, flag as needs_break, boundary as at_batch_boundary,
           flag or boundary as takes_break,
           case when boundary then 60 when flag then 30 else 0 end as cooling_s from plan"""

SQL["W3_break_schedule_high_baseline"] = _with("plan_high") + """
    select session_id, event_id, seq, boundary as at_batch_boundary,
           flag or boundary as takes_break,
           case when boundary then 60 when flag then 30 else 0 end as cooling_s
    from plan_high"""

SQL["W4_pair_start_end"] = _with("component_events") + """
    , paired as (
        select *, max(case when kind = 'start' then ts end)
                  over (partition by run_id, component order by ts, seq
                        rows unbounded preceding) as started from component_events)
    select run_id, component, seq,
           round(coalesce((epoch_us(ts) - epoch_us(started)) / 1e6, 0.0e0), 6) as elapsed_s,
           started is not null as matched
    from paired where kind = 'end'"""

SQL["W5_run_segments"] = _with("segments") + """
    select run_id, seq, cast(segment as bigint) as segment from segments"""

SQL["W6_number_items"] = _with("prompts") + """
    select prompt_id, mode, row_number() over (partition by mode order by prompt_id) as position,
           count(*) over (partition by mode) as total from prompts"""

SQL["W6_number_all_items"] = """
    select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as position,
           count(*) over () as total from orders"""

# No slug of the documents ends in a counter, so a file takes index 0 or nothing.
SQL["W7_unique_names"] = _with("slugs") + f"""
    , taken as (select distinct {_slug('text', 50)} as name from benchmark)
    , numbered as (
        select prompt_id, slug,
               row_number() over (partition by slug order by prompt_id) - 1
                 + case when slug in (select name from taken) then 1 else 0 end as name_index
        from slugs)
    select prompt_id, slug, name_index,
           case when name_index = 0 then concat(slug, '.png')
                else concat(slug, '_', cast(name_index as varchar), '.png') end as name
    from numbered"""

SQL["W7_unique_names_contested"] = """
    with recursive asked as (
        select p_partkey as prompt_id, regexp_extract(p_name, '^[a-z]+', 0) as family,
               concat(regexp_extract(p_name, '^[a-z]+', 0),
                      case when p_partkey % 3 = 0
                           then concat('_', cast(p_partkey % 40 + 1 as varchar)) else '' end)
                   as slug,
               row_number() over (partition by regexp_extract(p_name, '^[a-z]+', 0)
                                  order by p_partkey) as step
        from part),
    named as (
        select family, step, prompt_id, slug, cast(0 as bigint) as name_index, [slug] as taken
        from asked where step = 1
        union all
        select family, step, prompt_id, slug, i,
               list_append(taken, case when i = 0 then slug
                                       else concat(slug, '_', cast(i as varchar)) end)
        from (select a.family, a.step, a.prompt_id, a.slug, n.taken,
                     list_filter(range(0, len(n.taken) + 1), lambda i: not list_contains(n.taken,
                         case when i = 0 then a.slug
                              else concat(a.slug, '_', cast(i as varchar)) end))[1] as i
              from named n join asked a on a.family = n.family and a.step = n.step + 1))
    select prompt_id, slug, name_index,
           case when name_index = 0 then concat(slug, '.png')
                else concat(slug, '_', cast(name_index as varchar), '.png') end as name
    from named"""

SQL["W8_random_pick"] = _with("prompts") + """
    select mode, prompt_id, text from (
        select *, row_number() over (partition by mode
                  order by md5(concat_ws('|', '42', cast(prompt_id as varchar))), prompt_id) as rn
        from prompts) where rn = 1"""

SQL["W8_pick_for_modes"] = _with("prompts") + """
    , picks as (
        select mode, prompt_id from (
            select *, row_number() over (partition by mode
                      order by md5(concat_ws('|', '7', cast(prompt_id as varchar))), prompt_id)
                      as rn from prompts) where rn = 1)
    , asked as (select page_id, regexp_extract(url, '\\.com/([a-z]+)/', 1) as mode from pages)
    select page_id, a.mode,
           coalesce(p.prompt_id, (select prompt_id from picks where mode = 'en')) as prompt_id
    from asked a left join picks p on a.mode = p.mode"""

SQL["W9_replay_edits"] = _with("rects") + """
    select image_id, seq, rect_id, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2,
           round(y2, 6) as y2 from rects"""

SQL["W10_consecutive_duplicates"] = """
    select user_id, event_id,
           coalesce(event_type = lag(event_type)
                    over (partition by user_id order by ts, event_id), false) as is_duplicate
    from events"""

SQL["W10_consecutive_duplicate_vectors"] = """
    select vec_id, coalesce(embedding = lag(embedding)
                            over (partition by label order by vec_id), false) as is_duplicate
    from embeddings"""

SQL["K1_latest_asset"] = _with("assets") + f"""
    select path, strftime(mtime, {TIME}) as mtime, length from assets
    order by assets.mtime desc, path desc limit 1"""

SQL["K2_new_assets"] = _with("assets") + f"""
    select path, strftime(mtime, {TIME}) as mtime from assets where not was_there"""

SQL["K3_first_occurrence"] = """
    select page_id,
           array_to_string(list_filter(parts,
               lambda p, i: p <> 'fr' or i = list_position(parts, 'fr')), '/') as kept
    from (select page_id, string_split(concat(url, '/fr/de/fr'), '/') as parts from pages)"""

SQL["X1_slugify"] = _with("prompts") + f"""
    select prompt_id, {_slug('text', 50)} as slug, {_slug('text', 30)} as slug_30 from prompts"""

SQL["X2_session_key"] = _with("prompts") + f"""
    , dated as (select *, strftime(date '2025-01-01' + cast(prompt_id % 300 as integer), '%Y%m%d')
                as day from prompts)
    select prompt_id, {_key("coalesce(nullif(text, ''), 'generation')")} as plain,
           concat({_key('mode')}, '_', day) as dated,
           concat(lower({_words('text')}[1]), '_allsteps_', day) as all_steps
    from dated"""

SQL["X3_normalize_base"] = """
    with base as (
        select page_id, regexp_extract(url, '([a-z]+/[0-9]+)', 1) as middle,
               case when page_id % 2 = 0 then '/data/' else '' end as root,
               case page_id % 3 when 0 then '/outputs' when 1 then '/x/outputs/y' else '' end
                   as tail from pages)
    select page_id,
           case when page_id % 5 = 0 then 'outputs'
                when middle = '' and page_id % 3 <> 1 then 'outputs'
                else concat(root, 'outputs', case when middle = '' then '' else '/' end, middle,
                            case when page_id % 3 = 1 then '/x/y' else '' end) end as base
    from base"""

SQL["X4_sequence_name"] = """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
           printf('step_%03d_of_%03d.png', l_linenumber, l_partkey) as frame,
           printf('sunset_%02dsteps.png', l_linenumber) as short,
           printf('study_%04dsteps.png', l_orderkey) as long
    from lineitem"""

SQL["X5_token_count"] = _with("prompts") + f"""
    select prompt_id, cast(len({_words('text')}) as integer) as tokens from prompts"""

SQL["X6_escape_markup"] = """
    select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
                            '>', '&gt;'), chr(160), '&nbsp;') as escaped
    from pages"""

SQL["X7_labels"] = _with("requests") + """
    select request_id, concat_ws('×', cast(width as varchar), cast(height as varchar)) as size,
           case when seed = 0 then 'random' else cast(seed as varchar) end as seed
    from requests"""

SQL["V1_guidance_blend"] = _with("vector_pairs") + """
    , cells as (select pair_id, unnest(range(0, len(u))) as i, cast(unnest(u) as double) as a,
                       cast(unnest(t) as double) as b from vector_pairs)
    select pair_id, cast(i as integer) as i, round(a + 7.5e0 * (b - a), 6) as value from cells"""

SQL["V2_quantize_u8"] = """
    with cells as (select vec_id, unnest(range(0, len(embedding))) as i,
                          cast(unnest(embedding) as double) as x from embeddings)
    select vec_id, cast(i as integer) as i,
           cast(round_even(least(greatest(x / 0.25e0 / 2 + 0.5e0, 0), 1) * 255, 0) as integer)
               as level
    from cells"""

SQL["V3_split_join"] = _with("vector_pairs") + """
    select pair_id, cast(unnest(range(0, len(u))) as integer) as i,
           round(cast(unnest(u) as double), 6) as first,
           round(cast(unnest(t) as double), 6) as second from vector_pairs"""

SQL["T1_latest_state"] = _with("state_events") + """
    select run_id, seq, component, progress, total, message,
           round(time_per_step, 6) as time_per_step
    from (select *, row_number() over (partition by run_id order by ts desc, seq desc) as rn
          from state_events) where rn = 1"""

SQL["T2_stream_progress"] = _with("state_events") + f"""
    , timed as (select *, {PERCENT} as percent, {ETA} as remaining from state_events)
    select run_id, seq,
           cast(coalesce(list_position({ORDER}, component), 0) - 1 as integer) as stage_index,
           round(percent, 6) as percent, round(remaining, 6) as remaining_s,
           {ETA_TEXT} as remaining
    from timed"""

SQL["T3_stream_component_times"] = _with("segments") + PAIRED + """
    , counted as (select *, cast(round(elapsed_s * 1e6) as bigint) as us from ended)
    , changed as (
        select *, us - coalesce(lag(us) over (partition by run_id, segment, component
                                              order by ts, seq), 0) as change from counted)
    , summed as (
        select *, sum(change) over (partition by run_id, segment order by ts, seq
                                    rows unbounded preceding) as total from changed)
    , shared as (
        select *, case when total <> 0 then us / total * 100.0e0 end as percent from summed)
    select run_id, cast(segment as bigint) as segment, component, seq,
           round(elapsed_s, 6) as elapsed_s, matched, round(percent, 6) as percent from shared"""

SQL["T4_stream_thermal"] = _with("plan") + """
    select t.session_id, t.event_id, t.seq, case when t.seq >= 3 then round(b, 6) end as baseline,
           case when t.seq >= 3 then round(ratio, 6) end as performance_ratio,
           case when t.seq >= 3 then ratio < 1.0 / 1.5e0 end as is_throttled,
           p.flag as needs_break, p.flag or boundary as takes_break,
           case when boundary then 60 when p.flag then 30 else 0 end as cooling_s
    from thermal t join plan p on t.session_id = p.session_id and t.seq = p.seq"""

SQL["T5_run_status"] = _with("state_events") + """
    , marked as (
        select *, case when component = 'complete' then 'complete'
                       when component = 'idle' and message like 'Error:%' then 'failed'
                       else 'active' end as s from state_events)
    select run_id, arg_max(s, (ts, seq)) as status, bool_or(s = 'complete') as ever_completed,
           bool_or(s = 'failed') as ever_failed, count(*) as events
    from marked group by run_id"""

IDLE = """
    with idle as (
        select user_id, ts, event_id, case user_id % 4 when 1 then 300 when 2 then 86400
                                           when 3 then 7200 end as gap_s from events)"""

SQL["T6_idle_sessions"] = IDLE + f"""
    , seen as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before
               from idle)
    , numbered as (
        select *, sum(case when before is null
                             or epoch_us(ts) - epoch_us(before) >= cast(gap_s as bigint) * 1000000
                           then 1 else 0 end)
                  over (partition by user_id order by ts, event_id rows unbounded preceding)
                  as session_no from seen)
    select user_id, cast(session_no as bigint) as session_no,
           strftime(min(ts), {TIME}) as started, strftime(max(ts), {TIME}) as last_seen,
           count(*) as events
    from numbered group by user_id, session_no"""

SQL["T6_open_sessions_stream"] = IDLE + f"""
    select user_id, strftime(min(ts), {TIME}) as started, strftime(max(ts), {TIME}) as last_seen,
           count(*) as events
    from idle where gap_s is null group by user_id"""

SQL["T6_closed_sessions_stream"] = IDLE + f"""
    , timed as (select * from idle where gap_s is not null)
    , seen as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before
               from timed)
    , numbered as (
        select *, sum(case when before is null
                             or epoch_us(ts) - epoch_us(before) >= cast(gap_s as bigint) * 1000000
                           then 1 else 0 end)
                  over (partition by user_id order by ts, event_id rows unbounded preceding)
                  as session_no from seen)
    select user_id, strftime(min(ts), {TIME}) as started, strftime(max(ts), {TIME}) as last_seen,
           count(*) as events
    from numbered group by user_id, session_no, gap_s
    having epoch_us(max(ts)) + cast(gap_s as bigint) * 1000000
           <= (select epoch_us(max(ts)) from timed) - 3600000000"""

SQL["T7_fan_out"] = _with("state_events") + """
    select receiver, run_id, seq, component
    from state_events cross join (select unnest(['first', 'second', 'third']) as receiver)"""

SQL["U1_batch_infer"] = """
    select vec_id, round(sqrt(list_sum(list_transform(embedding,
               lambda x: cast(x as double) * cast(x as double)))), 6) as norm,
           cast(null as varchar) as error
    from embeddings"""

SQL["U1_batch_infer_bytes"] = """
    select vec_id, array_to_string(list_transform(embedding, lambda x:
               printf('%02x', cast(floor(cast(x as double) * 100) as integer) & 255)), '') as image,
           cast(len(embedding) as integer) as size, cast(null as varchar) as error
    from embeddings"""

SQL["U2_with_step_hook"] = """
    select user_id, event_id, step_index, round(step_index * value, 6) as captured from (
        select user_id, event_id, value,
               row_number() over (partition by user_id order by ts, event_id) - 1 as step_index
        from events) where step_index % 5 = 0"""

SQL["U3_expand_batch"] = """
    select doc_id as batch_id, cast(unnest(range(1, len(lines) + 1)) as integer) as position,
           cast(len(lines) as integer) as total, unnest(lines) as prompt, 42 as seed
    from (select doc_id, string_split(text, chr(10)) as lines from documents)"""
