"""Independent answers to the named queries, as SQL for DuckDB over the same tables.

The SQL takes its own way to each answer (window sums instead of folds, line lists instead of whole-text regexes).
"""

from __future__ import annotations

from codetrials.plans.derived import JEST_FULL, JEST_HALF, JEST_NONE
from codetrials.schemas import TASK_FIELDS

# The labels, rulers and patterns in the SQL below are those that the reports and rewrites must have.
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}

NL = "chr(10)"
ESC = "chr(27)"


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def oracle(name: str, uses: str, sql: str) -> None:
    """``uses`` lists the views to put in front, in order."""
    heads = [f"{v} as ({VIEWS[v]})" for v in uses.split()]
    ORACLES[name] = ("with " + ",\n".join(heads) + "\n" if heads else "") + sql


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- derived tables ------------------------------------------------------------------------------------------------------

view(
    "d_cells",
    """select conv_id as notebook, turn * 3 + k as pos,
  case when k = 1 and role = 'system' then 'code' else 'markdown' end as cell_type,
  case when k = 0 then '### ' || case turn % 4 when 0 then 'task_id' when 1 then 'prompt'
                                   when 2 then 'canonical_solution' else 'not_a_field' end
       when k = 1 and turn % 3 = 1 then '# Put your text here' else text end as source
from conversations, (values (0), (1), (2)) z(k) where not (k = 2 and turn % 3 <> 1)""",
)
view(
    "d_tasks",
    """select u.conv_id * 100 + u.turn as task_id,
  case u.conv_id % 5 when 0 then 'Python' when 1 then 'C++' when 2 then 'Java' when 3 then 'JavaScript'
       else 'Go' end as language,
  '  ' || u.text || '  ' as prompt,
  '    ' || replace(a.text, chr(10), chr(10) || '      ') as canonical_solution,
  'wrong ' || a.text as incorrect_solution,
  'Cls' || u.conv_id || ':run' as entry_point,
  '["' || replace(a.text, chr(10), '","') || '"]' as test
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'""",
)
view(
    "d_runs",
    """select event_id as run_id, event_id % 100 as task_id, chr(65 + cast(event_id % 26 as int)) as impl, ts,
  case when k = 0 then 'compile' else 'run' end as phase,
  cast(case when k = 0 then case when event_type = 'error' then 1 else 0 end
       else case when event_type = 'view' then 1 when event_type = 'signup' then null else 0 end end as int) as returncode,
  (k = 1 and event_type = 'signup') as timed_out,
  'out ' || event_id as stdout,
  case when event_id % 7 = 0 then 'x.cpp:1: error: ' || event_type else '' end as stderr
from events, (values (0), (1)) z(k)""",
)
view(
    "d_jacoco",
    """select l_orderkey as run_id,
  case when l_suppkey % 10 = 0 then 'org.junit.C' when l_suppkey % 10 = 1 then 'org.mockito.C' else 'app.C' end
    || l_partkey as class,
  cast(l_quantity as bigint) as line_covered, cast(50 - l_quantity as bigint) as line_missed,
  cast(l_discount * 100 as bigint) as branch_covered, cast(l_linenumber as bigint) as branch_missed,
  cast(l_quantity * 3 as bigint) as instruction_covered, cast(l_linenumber * 2 as bigint) as instruction_missed
from lineitem""",
)
view(
    "d_jest",
    f"""select event_id % 100 as task_id, event_id as run_id, event_type,
  case when event_type in ('click', 'error', 'view') then 1 else 0 end as returncode,
  'model' || (cast(floor(event_id / 100) as bigint) % 5) as impl,
  case event_type when 'signup' then '{{}}' when 'view' then 'not json' when 'error' then {quoted(JEST_NONE)}
    when 'click' then {quoted(JEST_HALF[0])} || event_id || {quoted(JEST_HALF[1])} else {quoted(JEST_FULL)} end as stdout,
  case when event_type in ('click', 'view') then 'failed in run ' || event_id end as stderr
from events""",
)
view(
    "j_parsed",
    """select *, cast(j ->> '$.numPassedTests' as int) as passed, cast(j ->> '$.numTotalTests' as int) as total,
  json_extract(j, '$.testResults[0]') as suite
from (select *, case when json_valid(stdout) then cast(stdout as json) end as j from d_jest)""",
)
view(
    "j_v2",
    """select * exclude (passed, total), case when suite is null then 0 else coalesce(passed, 0) end as passed,
  case when suite is null then 0 else coalesce(total, 0) end as total,
  case when suite is null then 'ERROR' when coalesce(passed, 0) = coalesce(total, 0) then 'PASSED' else 'FAILED' end as status
from j_parsed""",
)
view(
    "j_v1",
    """select * exclude (passed, total),
  case when returncode = 0 and suite is null or returncode <> 0 and j is null then 0 else coalesce(passed, 0) end as passed,
  case when returncode = 0 and suite is null or returncode <> 0 and j is null then 0 else coalesce(total, 0) end as total,
  case when returncode = 0 then case when suite is not null and passed is not distinct from total then 'PASSED' else 'FAILED' end
       when j is null then 'ERROR' else 'FAILED' end as status
from j_parsed""",
)
view(
    "j_cases",
    """select run_id, task_id, impl, i - 1 as pos, json_extract_string(suite, '$.assertionResults[' || (i - 1) || '].title') as title,
  json_extract_string(suite, '$.assertionResults[' || (i - 1) || '].status') as status,
  array_to_string(from_json(json_extract(suite, '$.assertionResults[' || (i - 1) || '].failureMessages'), '["VARCHAR"]'), chr(10)) as failure
from (select *, unnest(range(1, cast(json_array_length(suite, '$.assertionResults') as bigint) + 1)) as i
      from j_parsed where suite is not null)""",
)
view(
    "g_runs",
    """select run_id, task_id, impl,
  case when contains(stdout || stderr, 'compileJava FAILED') or contains(stdout || stderr, 'error:') then 'FAILED_TO_RUN'
       when returncode = 0 then 'PASSED' else 'FAILED' end as status,
  stdout || stderr as output,
  case when contains(stdout || stderr, 'compileJava FAILED') or contains(stdout || stderr, 'error:') then 'Compilation failed'
       when returncode = 0 then null else 'Tests failed with return code: ' || coalesce(cast(returncode as varchar), 'None') end as error
from d_runs where phase = 'run'""",
)
view(
    "c_runs",
    """select r.run_id, r.task_id, r.impl,
  case when c.returncode <> 0 then 'COMPILE ERROR' when r.timed_out then 'TIMEOUT' when r.returncode = 0 then 'PASS' else 'FAIL' end as status,
  case when c.returncode <> 0 then c.stderr when r.timed_out then 'Execution timed out.' else r.stdout || r.stderr end as output
from d_runs r join d_runs c using (run_id) where r.phase = 'run' and c.phase = 'compile'""",
)
view(
    "cov",
    """select run_id, cast(sum(instruction_covered + instruction_missed) as bigint) as total_instructions,
  cast(sum(instruction_covered) as bigint) as covered_instructions,
  cast(sum(branch_covered + branch_missed) as bigint) as total_branches, cast(sum(branch_covered) as bigint) as covered_branches,
  cast(sum(line_covered + line_missed) as bigint) as total_lines, cast(sum(line_covered) as bigint) as covered_lines
from d_jacoco where class not like 'org.junit%' and class not like 'org.mockito%' group by run_id""",
)


def pct(part: str, total: str) -> str:
    return f"case when {total} > 0 then cast({part} as double) / cast({total} as double) * 100 else cast(0 as double) end"


view(
    "cov_pct",
    f"""select run_id, total_instructions, covered_instructions, {pct('covered_instructions', 'total_instructions')} as instruction_coverage,
  total_branches, covered_branches, {pct('covered_branches', 'total_branches')} as branch_coverage,
  total_lines, covered_lines, {pct('covered_lines', 'total_lines')} as line_coverage from cov""",
)
view(
    "overall",
    f"""select {pct('cl', 'tl')} as overall_coverage, {pct('ci', 'ti')} as instruction_coverage,
  {pct('cb', 'tb')} as branch_coverage, {pct('cl', 'tl')} as line_coverage
from (select sum(covered_lines) cl, sum(total_lines) tl, sum(covered_instructions) ci, sum(total_instructions) ti,
             sum(covered_branches) cb, sum(total_branches) tb
      from g_runs join cov using (run_id) where status = 'PASSED')""",
)
view(
    "cohorts",
    f"""select cohort, count(status) as total, count(*) filter (where status = 'PASSED') as passed,
  count(*) filter (where status in ('FAILED', 'FAILED_TO_RUN')) as failed
from (values ('first', 'A', 'E'), ('second', 'F', 'J')) c(cohort, lo, hi)
left join g_runs on impl between lo and hi group by cohort""",
)
view(
    "mixed",
    """select run_id, status,
  case when run_id % 3 = 0 then lower(impl) when run_id % 5 = 0 then impl || impl else impl end || '.java' as file_name
from g_runs""",
)
view(
    "d_tests",
    """select item_id as task_id, 'Java' as language, 'test/SolutionTest.java' as path,
  case when item_id % 2 = 0 then 'class SolutionTest ' else 'class MainTest ' end || text as content from benchmark""",
)
view(
    "d_docs",
    """select doc_id, cast(floor(doc_id / 10) as bigint) as task_id, chr(65 + cast(doc_id % 10 as int)) as impl, text
from documents""",
)
view(
    "d_java",
    """select task_id, impl, 'Main' || chr(65 + cast(doc_id % 26 as int)) as cls, 'code/' || impl || '.java' as path,
  case when doc_id % 5 = 0 then 'private class Inner {}' || chr(10) else '' end
  || case when doc_id % 7 = 0 then 'class ' else 'public class ' end || 'Main' || chr(65 + cast(doc_id % 26 as int))
  || ' {' || chr(10) || ' private  static int x;' || chr(10) || ' protected final static int y;' || chr(10) || ' protected int z;' || chr(10) || '// '
  || replace(replace(replace(text, ' the ', ' private Main' || chr(65 + cast(doc_id % 26 as int)) || ' '),
       ' of ', ' new Main' || chr(65 + cast(doc_id % 26 as int)) || '() '),
       ' and ', ' new Main' || chr(65 + cast(doc_id % 26 as int)) || '<>() ')
  || chr(10) || '}' as content
from d_docs""",
)
view(
    "d_js",
    r"""select task_id, impl, './alternate_responses/' || impl || '.js' as path,
  '  function first() {}' || chr(10) || 'function top() {' || chr(10) || '}' || chr(10)
  || replace(replace(replace(regexp_replace(text, '\. ([A-Za-z]+) ', '.' || chr(10) || 'function \1 (a) {' || chr(10) || '}' || chr(10), 'g'),
       'function T', 'async function _T'), ' of ', ' { '), ' and ', ' } ')
  || case when doc_id % 3 = 0 then chr(10) || 'module.exports = { old,' || chr(10) || ' older };' || chr(10) else '  ' || chr(10) end as content
from d_docs""",
)
view(
    "js_split",
    """select task_id, impl, unnest(string_split(content, chr(10))) as line,
  generate_subscripts(string_split(content, chr(10)), 1) as pos from d_js""",
)
JS_FUNCTION = r"^(?:async\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("


def net(line: str) -> str:
    opened = f"(length({line}) - length(replace({line}, '{{', '')))"
    return f"({opened} - (length({line}) - length(replace({line}, '}}', ''))))"


view(
    "js_depth",
    f"""select *, coalesce(sum({net('line')}) over (partition by task_id, impl order by pos rows between unbounded preceding and 1 preceding), 0) as depth,
  regexp_extract(line, '{JS_FUNCTION}', 1) as name from js_split""",
)
view(
    "js_exports",
    """select task_id, impl, coalesce(string_agg(name, ',' order by pos) filter (where depth = 0 and name <> '' and not starts_with(name, '_')), '') as exports
from js_depth group by task_id, impl""",
)
view(
    "d_js_tests",
    """select item_id as task_id, text || chr(10) || s || ';' || chr(10) || s || ';' || chr(10) as content
from (select *, case item_id % 3 when 0 then 'const {  fn' || item_id || ' } = require(''./solution'')'
        when 1 then 'const Cls' || item_id || '  = require("./solution.js")' else 'import x' end as s from benchmark)""",
)
view(
    "d_cpp",
    """select task_id, impl, 'int f() {' || chr(10) || ' return 1;' || chr(10) || '}' || chr(10)
  || case doc_id % 4 when 0 then 'int main()' || chr(10) || '{' || chr(10) when 1 then 'int main() {' || chr(10)
       when 2 then 'int  main(int a, char** b)' || chr(10) || '{' || chr(10) || '  {' || chr(10) else 'int mains()' || chr(10) || '{' || chr(10) end
  || replace(replace(replace(text, '. ', ';' || chr(10)), ' of ', chr(10) || '}' || chr(10)), ' and ', chr(10) || chr(9) || 'int main (void)' || chr(10) || '{' || chr(10))
  || chr(10) || '}' || chr(10) || 'int g() {' || chr(10) || '}' as content
from d_docs""",
)
view(
    "cpp_lines",
    r"""select task_id, impl, pos, line, regexp_matches(line, '^[ \t]*int[ \t]+main[ \t]*\(.*\)') as head,
  sum(cast(regexp_matches(line, '^[ \t]*int[ \t]+main[ \t]*\(.*\)') as int)) over (partition by task_id, impl order by pos) as seg
from (select task_id, impl, unnest(string_split(content, chr(10))) as line,
        generate_subscripts(string_split(content, chr(10)), 1) as pos from d_cpp)""",
)
view(
    "d_logs",
    """select doc_id as run_id, chr(27) || '[1;32m' || source || chr(27) || '[0m' || chr(10) || '/Users/me/' || lang || chr(10) || text as log
from documents""",
)

# --- notebooks -------------------------------------------------------------------------------------------------------------

FIELD_LIST = ", ".join(f"'{f}'" for f in TASK_FIELDS)


def field_steps(cells: str) -> str:
    return f"""select notebook, armed as field, source as value, pos from (
  select *, lag(fld) over (partition by notebook order by pos) as armed from (
    select *, case when starts_with(source, '### ') and trim(substr(source, 5)) in ({FIELD_LIST}) then trim(substr(source, 5)) end as fld
    from {cells} where cell_type = 'markdown' and not starts_with(source, '# Put')))
where fld is null and armed is not null"""


view("fields", field_steps("d_cells"))
oracle("notebook_fields", "d_cells fields", "select * from fields")
oracle(
    "notebook_records",
    "d_cells fields",
    "select notebook, "
    + ", ".join(f"max_by(value, pos) filter (where field = '{f}') as {f}" for f in TASK_FIELDS)
    + " from fields group by notebook",
)
view(
    "p_cells",
    """select 'nb' || doc_id as notebook, doc_id, row_number() over (partition by doc_id order by i, head desc) - 1 as pos,
  case when head = 1 or i % 5 <> 4 then 'markdown' else 'code' end as cell_type,
  case when head = 1 then '### ' || case when i % 2 = 0 then 'prompt' else 'test' end
       when i % 2 = 0 then line || chr(10) || 'end' else line end as source
from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
     (values (0), (1)) h(head)
where (head = 0 or i % 3 = 0) and doc_id % 50 <> 49""",
)
oracle("notebook_scan", "p_cells", "select notebook, cast(pos as int) as pos, cell_type, source from p_cells")
oracle(
    "notebook_fields_nested",
    "p_cells",
    "select notebook, field, value, cast(pos as int) as pos from (" + field_steps("p_cells") + ")",
)
view("p_fields", field_steps("p_cells"))
oracle(
    "notebook_records_nested",
    "p_cells p_fields",
    "select notebook, "
    + ", ".join(f"max_by(value, pos) filter (where field = '{f}') as {f}" for f in TASK_FIELDS)
    + " from p_fields group by notebook",
)
oracle(
    "notebook_quarantine",
    "",
    "select 'nb' || doc_id as notebook, 'not a version 4 notebook' as reject_reason from documents where doc_id % 50 = 49",
)

# --- tasks -----------------------------------------------------------------------------------------------------------------

oracle(
    "task_scan",
    "d_tasks",
    "select "
    + ", ".join(
        "cast(task_id as varchar) as task_id"
        if f == "task_id"
        else f
        if f in ("prompt", "canonical_solution", "incorrect_solution", "entry_point", "test", "language")
        else f"cast(null as varchar) as {f}"
        for f in TASK_FIELDS
    )
    + " from d_tasks",
)
oracle(
    "task_json",
    "d_tasks",
    """select '{"task_id":' || task_id || ',"language":' || to_json(language) || ',"prompt":' || to_json(prompt)
  || ',"canonical_solution":' || to_json(canonical_solution) || ',"incorrect_solution":' || to_json(incorrect_solution)
  || case when task_id % 3 <> 0 then ',"entry_point":' || to_json(entry_point) else '' end
  || ',"test":' || to_json(test) || '}' as value from d_tasks""",
)
oracle(
    "decode_tests",
    "d_tasks",
    """select task_id, cast(len(l) as int) as n_tests, array_to_string(l, '|') as tests
from (select task_id, from_json(test, '["VARCHAR"]') as l from d_tasks)""",
)
oracle(
    "decode_tests_literal",
    "d_tasks",
    """select task_id, case task_id % 5 when 0 then body when 1 then body when 2 then 'Ab|' || body when 3 then null
  else 'it''s|' || body end as tests
from (select task_id, array_to_string(from_json(test, '["VARCHAR"]'), '|') as body from d_tasks)""",
)
oracle(
    "task_quarantine",
    "d_tasks",
    """select * from (select task_id, language, case when language = 'Go' then 'unsupported language'
    when task_id % 7 = 0 then 'missing prompt'
    when language = 'Java' and task_id % 11 = 0 then 'missing entry_point'
    when task_id % 13 = 0 then 'unreadable test' end as reject_reason from d_tasks) where reject_reason is not null""",
)
oracle(
    "task_routing",
    "d_tasks",
    """select *, count(*) filter (where reject_reason is null) over () as n_usable, count(*) filter (where reject_reason is not null) over () as n_rejected
from (select task_id, language, case when reject_reason is null then 'usable' else 'rejected' end as outcome, reject_reason, n_tests
  from (select task_id, language, case when language = 'Go' then 'unsupported language' when task_id % 7 = 0 then 'missing prompt'
      when language = 'Java' and task_id % 11 = 0 then 'missing entry_point' when task_id % 13 = 0 then 'unreadable test' end as reject_reason,
    case when task_id % 13 <> 0 then cast(len(from_json(test, '["VARCHAR"]')) as int) end as n_tests from d_tasks))""",
)
oracle("language_routing", "d_tasks", "select task_id, language, language <> 'Go' as handled from d_tasks")
oracle("entry_class", "d_tasks", "select task_id, split_part(entry_point, ':', 1) as entry_class from d_tasks")
oracle(
    "solution_variants",
    "d_tasks",
    """select task_id, 'ir' as variant, canonical_solution as solution from d_tasks
union all select task_id, 'incs', incorrect_solution from d_tasks""",
)

SPACE = "chr(9) || chr(10) || chr(13) || ' '"


def lines_of(text: str) -> str:
    return f"string_split({text}, {NL})"


def dedent(text: str) -> str:
    """Line-list form of dedent for texts whose white space is blanks, tabs and line feeds."""
    indents = (
        f"list_transform(list_filter({lines_of(text)}, lambda l: trim(l, ' ' || chr(9)) <> ''), "
        "lambda l: regexp_extract(l, '^[ \\t]*'))"
    )
    lo, hi = f"coalesce(list_min({indents}), '')", f"coalesce(list_max({indents}), '')"
    margin = f"len(list_filter(range(1, length({lo}) + 1), lambda i: left({lo}, i) = left({hi}, i)))"
    cut = f"case when trim(l, ' ' || chr(9)) = '' then '' else substr(l, {margin} + 1) end"
    return f"array_to_string(list_transform({lines_of(text)}, lambda l: {cut}), {NL})"


def indent(text: str) -> str:
    return (
        f"array_to_string(list_transform({lines_of(text)}, "
        f"lambda l: case when trim(l, ' ' || chr(9)) = '' then l else '    ' || l end), {NL})"
    )


view(
    "dd",
    r"""select doc_id, ' ' || chr(9) || ' ' || replace(regexp_replace(text, '\. ', '.' || chr(10) || ' ' || chr(9) || chr(10) || ' ' || chr(9) || '  ', 'g'),
  chr(10), chr(10) || ' ' || chr(9)) as t from documents""",
)
view("dd_lines", f"select doc_id, unnest({lines_of('t')}) as line, generate_subscripts({lines_of('t')}, 1) as pos from dd")
view(
    "dd_margin",
    """select doc_id, len(list_filter(range(1, length(lo) + 1), lambda i: left(lo, i) = left(hi, i))) as margin
from (select doc_id, min(ind) as lo, max(ind) as hi from (
  select doc_id, regexp_extract(line, '^[ \\t]*') as ind from dd_lines where trim(line, ' ' || chr(9)) <> '') group by doc_id)""",
)
# With its first line stripped a text has no common margin left: only its blank lines change.
oracle(
    "text_dedent",
    "dd dd_lines dd_margin",
    f"""select doc_id, d as dedented, {indent('d')} as indented,
  array_to_string(list_transform({lines_of('s')}, lambda l: case when trim(l, ' ' || chr(9)) = '' then '' else l end), {NL}) as stripped_first
from (select doc_id, string_agg(case when trim(line, ' ' || chr(9)) = '' then '' else substr(line, margin + 1) end, {NL} order by pos) as d
      from dd_lines left join dd_margin using (doc_id) group by doc_id)
join (select doc_id, trim(t, {SPACE}) as s from dd) using (doc_id)""",
)
view(
    "v_tasks",
    """select t.*, v.variant, case v.variant when 'ir' then canonical_solution else incorrect_solution end as sol,
  from_json(test, '["VARCHAR"]') as tests from d_tasks t, (values ('ir'), ('incs')) v(variant)""",
)
TESTS = f"array_to_string(list_transform(tests, lambda t: '%s' || trim(t, {SPACE})), {NL})"
PLAIN_TESTS = f"array_to_string(tests, {NL})"
PROMPT = f"trim(prompt, {SPACE})"
RENDER = {
    "render_cpp": (
        "C++",
        "variant || '.cpp'",
        f"""'#include <iostream>' || {NL} || '#include <cassert>' || {NL} || 'using namespace std;' || {NL} || {NL} || {PROMPT} || {NL} || {dedent('sol')}
  || {NL} || {NL} || 'int main() {{' || {NL} || {TESTS % '    '} || {NL} || '    cout << "All tests passed.\\n";' || {NL} || '    return 0;' || {NL} || '}}'""",
    ),
    "render_python": (
        "Python",
        "variant || '.py'",
        f"{PROMPT} || {NL} || {indent(dedent('sol'))} || {NL} || {NL} || '# Tests' || {NL} || {PLAIN_TESTS}",
    ),
    "render_java": (
        "Java",
        "split_part(entry_point, ':', 1) || '.java'",
        f"""{PROMPT} || {NL} || {indent(dedent(f'trim(sol, {SPACE})'))} || {NL} || {NL} || '    public static void main(String[] args) {{' || {NL}
  || {TESTS % '        '} || {NL} || '        System.out.println("All tests passed.");' || {NL} || '    }}' || {NL} || '}}'""",
    ),
    "render_js": (
        "JavaScript",
        "variant || '.js'",
        f"""'const assert = require(''assert'');' || {NL} || {NL} || {PROMPT} || {NL} || {dedent(f'trim(sol, {SPACE})')} || {NL} || {NL} || '// Tests' || {NL}
  || {PLAIN_TESTS} || {NL} || 'console.log("All tests passed.");'""",
    ),
}
for _name, (_language, _file, _source) in RENDER.items():
    oracle(
        _name,
        "d_tasks v_tasks",
        f"select task_id, language, variant, {_file} as file_name, {_source} as source from v_tasks where language = '{_language}'",
    )
oracle(
    "render_all",
    "d_tasks v_tasks",
    " union all ".join(
        f"select task_id, variant, language, {f} as file_name, {s} as source from v_tasks where language = '{lang}'"
        for lang, f, s in RENDER.values()
    ),
)

# --- source code -------------------------------------------------------------------------------------------------------------

oracle(
    "exported_functions",
    "",
    f"""select file_id, pos, name from (
  select *, coalesce(sum({net('line')}) over (partition by file_id order by pos rows between unbounded preceding and 1 preceding), 0) as depth,
    regexp_extract(line, '{JS_FUNCTION}', 1) as name
  from (select user_id as file_id, event_id as pos,
    case event_type when 'signup' then 'function f' || event_id || '(a) {{'
      when 'view' then 'async function ' || case when event_id % 2 = 0 then '_p' else 'g' end || event_id || '() {{ return {{'
      when 'error' then '}}' when 'purchase' then '}} }}' else '  return 1;' end as line from events))
where depth = 0 and name <> '' and not starts_with(name, '_')""",
)
oracle("exported_functions_text", "d_docs d_js js_split js_depth js_exports", "select * from js_exports")
oracle(
    "add_exports",
    "d_docs d_js js_split js_depth js_exports",
    r"""select task_id, impl, case when exports = '' then bare
  else trim(bare, chr(9) || chr(10) || chr(13) || ' ') || chr(10) || 'module.exports = { ' || replace(exports, ',', ', ') || ' };' || chr(10) end as content
from (select task_id, impl, exports, regexp_replace(content, 'module\.exports\s*=\s*\{[^}]*\};?\s*$', '') as bare
      from d_js join js_exports using (task_id, impl))""",
)
oracle(
    "remove_main",
    "d_docs d_cpp cpp_lines",
    r"""select task_id, impl, coalesce(string_agg(line || chr(10), '' order by pos) filter (where seg = 0 or pos > out), '') as content
from (select *, min(case when closing and bal = 0 then pos end) over (partition by task_id, impl, seg) as out
  from (select *, regexp_matches(line, '^[ \t]*\}') as closing,
      sum(case when regexp_matches(line, '^[ \t]*\{') then 1 when regexp_matches(line, '^[ \t]*\}') then -1 else 0 end)
        over (partition by task_id, impl, seg order by pos) as bal from cpp_lines))
group by task_id, impl""",
)
oracle(
    "remove_main_balanced",
    "d_docs d_cpp cpp_lines",
    f"""select task_id, impl, coalesce(string_agg(line || chr(10), '' order by pos) filter (where seg = 0 or pos > out), '') as content
from (select *, min(case when opened > 0 and bal <= 0 then pos end) over (partition by task_id, impl, seg) as out
  from (select *, sum({net('line')}) over (partition by task_id, impl, seg order by pos) as bal,
      sum(length(line) - length(replace(line, '{{', ''))) over (partition by task_id, impl, seg order by pos) as opened from cpp_lines))
group by task_id, impl""",
)
view(
    "one_file",
    r"""select lang, pos, line, sum(cast(head as int)) over (partition by lang order by pos) as seg
from (select coalesce(lang, 'none') as lang, (task_id * 10 + ascii(impl) - 65) * 1048576 + pos - 1 as pos, line, head
  from cpp_lines join documents on doc_id = task_id * 10 + ascii(impl) - 65)""",
)


def kept_lines(keys: str, lines: str, mode: str) -> str:
    """Lines outside of main functions, over whole files."""
    part = f"over (partition by {keys}, seg order by pos)"
    if mode == "balanced":
        count, ends = net("line"), "opened > 0 and bal <= 0"
        extra = f"sum(length(line) - length(replace(line, '{{', ''))) {part} as opened"
    else:
        closing = r"regexp_matches(line, '^[ \t]*\}')"
        count = rf"case when regexp_matches(line, '^[ \t]*\{{') then 1 when {closing} then -1 else 0 end"
        extra, ends = f"{closing} as closing", "closing and bal = 0"
    return f"""select {keys}, pos, line from (select *, min(case when {ends} then pos end) over (partition by {keys}, seg) as gone
  from (select *, sum({count}) {part} as bal, {extra} from {lines})) where seg = 0 or pos > gone"""


oracle(
    "remove_main_lines", "d_docs d_cpp cpp_lines",
    "select task_id, impl, cast(pos - 1 as int) as pos, line from (" + kept_lines("task_id, impl", "cpp_lines", "faithful") + ")",
)
for _name, _mode in (("remove_main_one_file", "faithful"), ("remove_main_one_file_balanced", "balanced")):
    oracle(_name, "d_docs d_cpp cpp_lines one_file", kept_lines("lang", "one_file", _mode))
view(
    "more_tests",
    """select * from d_tests union all
select task_id, language, 'test/ATest.java', replace('class MainTest ' || content, 'Solution', 'Other') from d_tests where task_id % 2 = 0
union all select task_id, language, 'test/ZTest.java', 'class ZTest {}' from d_tests where task_id % 2 = 0""",
)
oracle(
    "java_target_of_suites",
    "d_tests more_tests",
    """select task_id, case when contains(min_by(content, path), 'Solution') then 'Solution' else 'Main' end as target from more_tests group by task_id""",
)
oracle(
    "impl_test_fanout_of_suites",
    "d_docs d_tests more_tests",
    """select task_id, impl, test_path, test_content from d_docs
left join (select task_id, max(path) as test_path, max_by(content, path) as test_content from more_tests group by task_id) using (task_id)""",
)
oracle(
    "java_target",
    "d_tests",
    "select task_id, case when contains(content, 'Solution') then 'Solution' else 'Main' end as target from d_tests",
)
oracle(
    "normalize_java",
    "d_docs d_java d_tests",
    r"""select task_id, impl, target, case when cls <> '' and target is not null then
    replace(replace(regexp_replace(regexp_replace(opened, 'new ' || cls || '\b', 'new ' || chr(1), 'g'), '\b' || cls || '\b', target, 'g'),
      chr(1), cls), 'new ' || cls || '(', 'new ' || target || '(') end as content,
  case when target is null then 'no test file' when cls = '' then 'no public class' end as reject_reason
from (select task_id, impl, opened, regexp_extract(opened, 'public class (\w+)', 1) as cls,
    case when contains(t.content, 'Solution') then 'Solution' when t.content is not null then 'Main' end as target
  from (select task_id, impl, regexp_replace(regexp_replace(regexp_replace(content, '\b(private|protected)\s+static', 'public static', 'g'),
      '\b(private|protected)\s+final\s+static', 'public static final', 'g'), '\b(private|protected)\s+', 'public ', 'g') as opened from d_java)
  left join d_tests t using (task_id))""",
)
oracle(
    "rewrite_import",
    "d_docs d_js d_js_tests",
    r"""select task_id, impl, case when head is not null then regexp_replace(t.content,
    'const\s*(?:\{[^}]+\}|[^=\s]+)\s*=\s*require\([''"]\./[^''"]+[''"]\)', head || '(''' || path || ''')') end as content,
  case when t.content is null then 'no test file' when head is null then 'no require statement' end as reject_reason
from d_js left join (select *, case task_id % 3 when 0 then 'const { fn' || task_id || ' } = require'
    when 1 then 'const Cls' || task_id || ' = require' end as head from d_js_tests) t using (task_id)""",
)

# --- layout --------------------------------------------------------------------------------------------------------------------

_TREE = "select floor(doc_id / 10)::bigint::varchar as task_id, doc_id % 10 as kind, chr(65 + cast(doc_id % 10 as int)) as letter, text from documents"
oracle(
    "impl_scan_java",
    "",
    f"""select task_id, letter as impl, 'Java' as language,
  task_id || '/code/' || case when kind = 3 then 'sub/' else '' end || letter || '.java' as path, coalesce(text, '') as content
from ({_TREE}) where kind not in (1, 2, 4)""",
)
oracle(
    "impl_scan_python",
    "",
    f"""select task_id, letter as impl, 'Python' as language, task_id || '/' || letter || '.py' as path,
  coalesce(text, '') as content from ({_TREE}) where kind not in (1, 2, 3)""",
)
oracle(
    "impl_scan_js",
    "",
    f"""select task_id, letter || '.js' as impl, 'JavaScript' as language, task_id || '/' || letter || '.js' as path,
  coalesce(text, '') as content from ({_TREE}) where kind not in (1, 2, 3)""",
)
oracle(
    "impl_scan_js_v1",
    "",
    f"""select task_id, case kind when 1 then 'base_code' when 2 then 'solution' else letter || '.x.js' end as impl, 'JavaScript' as language,
  task_id || case kind when 1 then '/base_code.js' when 2 then '/solution.js' else '/alternate_responses/' || letter || '.js.x.js' end as path,
  coalesce(text, '') as content from ({_TREE}) where kind not in (0, 3)""",
)
oracle(
    "impl_scan_cpp",
    "",
    f"""select task_id, letter as impl, 'C++' as language, 'tasks/' || task_id || '/src/' || letter || '.cpp' as path,
  coalesce(text, '') as content from ({_TREE}) where kind not in (1, 2)""",
)
#: Where each runner looks, as a path of ``task_id``, ``kind`` and ``name``, what it calls the file, and the kinds it leaves out.
_FOLDERS = {
    "java": ("Java", "task_id || '/code/' || case when kind = 3 then 'sub/' else '' end || name || '.java'", "name", "1, 2, 4"),
    "python": ("Python", "task_id || '/' || name || '.py'", "name", "1, 2, 3"),
    "js": ("JavaScript", "task_id || '/' || name || '.js'", "name || '.js'", "1, 2, 3"),
    "js_v1": (
        "JavaScript",
        "task_id || case kind when 1 then '/base_code.js' when 2 then '/solution.js' else '/alternate_responses/' || name || '.js.x.js' end",
        "case kind when 1 then 'base_code' when 2 then 'solution' else name || '.x.js' end", "0, 3",
    ),
    "cpp": ("C++", "'tasks/' || task_id || '/src/' || name || '.cpp'", "name", "1, 2"),
}
view("d_tree", f"select *, case kind when 5 then '_' when 6 then '.' else '' end || letter as name from ({_TREE})")
for _layout, (_language, _path, _impl, _out) in _FOLDERS.items():
    oracle(
        f"folder_scan_{_layout}",
        "d_tree",
        f"""select task_id, {_impl} as impl, '{_language}' as language, {_path} as path, coalesce(text, '') as content,
  cast(null as varchar) as reject_reason from d_tree where kind not in ({_out})""",
    )
oracle(
    "folder_scan_of_tasks",
    "d_tree",
    f"""select task_id, name as impl, {_FOLDERS['python'][1]} as path, coalesce(text, '') as content from d_tree
where kind not in (1, 2, 3) and task_id::bigint % 7 = 0 and task_id::bigint < 1000""",
)
oracle(
    "metadata_scan",
    "",
    """select 'task' || doc_id as task_id, '' as time_to_develop_prompt, lang as programming_language, source as task_type,
  'hard' as difficulty, cast(n_chars as varchar) as estimated_skill_requirements, text as user_prompt, cast(null as varchar) as reject_reason
from documents""",
)
oracle(
    "impl_test_fanout",
    "d_docs d_tests",
    """select task_id, impl, 'code/' || impl || '.java' as path, t.path as test_path, t.content as test_content, text as content
from d_docs left join d_tests t using (task_id)""",
)
oracle(
    "layout_violations",
    "d_docs d_java d_js js_split js_depth js_exports d_js_tests",
    r"""select task_id, 'Java' as language, impl, 'many_public_classes' as rule from d_java
  where len(regexp_extract_all(content, 'public class')) > 1
union all select task_id, 'Java', impl, 'no_public_class' from d_java
  where not regexp_matches(regexp_replace(content, '\b(private|protected)\s+', 'public ', 'g'), 'public class \w')
union all select task_id, language, null, rule from (
  select distinct task_id, language, 'no_test_file' as rule from d_docs, (values ('Java'), ('JavaScript')) l(language)
  where task_id not in (select item_id from benchmark))
union all select item_id, language, null, 'no_code_files' from benchmark, (values ('Java'), ('JavaScript')) l(language)
  where item_id not in (select task_id from d_docs)
union all select task_id, 'JavaScript', null, 'no_require' from d_js_tests where not contains(content, 'require(')
union all select task_id, 'JavaScript', null, 'exports_differ' from js_exports group by task_id having count(distinct exports) > 1""",
)

# --- verdicts --------------------------------------------------------------------------------------------------------------------

oracle("verdict_compiled", "d_runs c_runs", "select * from c_runs")
oracle(
    "verdict_interpreted",
    "d_runs",
    """select run_id, task_id, impl, case when timed_out then 'TIMEOUT' when returncode = 0 then 'PASS' else 'FAIL' end as status,
  case when timed_out then 'Execution timed out.' else stdout || stderr end as output from d_runs where phase = 'run'""",
)
oracle(
    "verdict_gradle",
    "d_runs g_runs",
    """select run_id, task_id, impl, case when stopped is not null then 'FAILED_TO_RUN' else status end as status,
  case when stopped is not null then '' else output end as output, coalesce(stopped, error) as error, platform
from (select g.*, platform, case when run_id % 31 = 0 then 'boom ' || run_id
    when platform = 'mac' and run_id % 29 = 0 then 'Command ''[''gradle'', ''wrapper'']'' returned non-zero exit status ' || r.returncode || '.' end as stopped
  from g_runs g join (select run_id, returncode from d_runs where phase = 'run') r using (run_id), (values ('mac'), ('windows')) p(platform))""",
)
oracle(
    "build_gate",
    "d_runs",
    """select run_id, task_id, impl, returncode, timed_out, stdout, stderr from d_runs
where phase = 'run' and run_id in (select run_id from d_runs where phase = 'compile' and returncode = 0)""",
)
oracle(
    "build_skipped",
    "d_runs",
    """select run_id, task_id, impl from d_runs
where phase = 'run' and run_id not in (select run_id from d_runs where phase = 'compile' and returncode = 0)""",
)
view(
    "latest_variant",
    """select task_id as task_key, variant, max_by(status, run_id) as status, nullif(trim(max_by(output, run_id)), '') as output
from (select *, case when cast(floor(run_id / 100) as bigint) % 2 = 0 then 'ir' else 'incs' end as variant from c_runs)
group by 1, 2""",
)
view(
    "attached",
    """select task_id, language, prompt, a.status as ir_test_status, a.output as ir_test_output, b.status as incs_test_status, b.output as incs_test_output
from d_tasks t left join latest_variant a on a.task_key = floor(t.task_id / 100) and a.variant = 'ir'
left join latest_variant b on b.task_key = floor(t.task_id / 100) and b.variant = 'incs' where language <> 'Go'""",
)
oracle("attach_verdicts", "d_tasks d_runs c_runs latest_variant attached", "select * from attached")
ORACLES["attach_verdicts_bucketed"] = ORACLES["attach_verdicts"]
oracle(
    "discriminating_tasks",
    "d_tasks d_runs c_runs latest_variant attached",
    "select task_id, language from attached where ir_test_status = 'PASS' and incs_test_status <> 'PASS'",
)

oracle(
    "judged_runs",
    "d_tasks d_runs c_runs",
    """select r.run_id, r.task_id, r.impl,
  case when language in ('C++', 'Java') then c.status when timed_out then 'TIMEOUT' when returncode = 0 then 'PASS' else 'FAIL' end as status,
  case when language in ('C++', 'Java') then c.output when timed_out then 'Execution timed out.' else stdout || stderr end as output
from d_runs r join c_runs c using (run_id)
join (select distinct cast(floor(task_id / 100) as bigint) as task_id, language from d_tasks) l on l.task_id = r.task_id
where r.phase = 'run' and language <> 'Go'""",
)

oracle(
    "unjudged_runs",
    "d_tasks d_runs",
    """select distinct r.run_id, r.task_id, r.impl, case when l.task_id is null then 'unknown task' else 'unsupported language' end as reject_reason
from d_runs r left join (select distinct cast(floor(task_id / 100) as bigint) as task_id, language from d_tasks where floor(task_id / 100) % 2 = 0) l
  on l.task_id = r.task_id
where l.language is null or l.language = 'Go'""",
)

# --- Jest --------------------------------------------------------------------------------------------------------------------------

oracle(
    "jest_parse",
    "d_jest j_parsed",
    """select run_id, json_valid(stdout) as parsed, passed, total, suite ->> '$.status' as suite_status,
  cast(json_array_length(suite, '$.assertionResults') as int) as n_cases from j_parsed""",
)
oracle(
    "verdict_jest",
    "d_jest j_parsed j_v1 j_v2",
    """select run_id, passed, total, status, 'v1' as version from j_v1
union all select run_id, passed, total, status, 'v2' from j_v2""",
)
view(
    "j_summary",
    """select task_id, impl, max_by(passed, run_id) as passed, max_by(total, run_id) as total, max_by(status, run_id) as status
from j_v2 group by task_id, impl""",
)
oracle("test_summary", "d_jest j_parsed j_v2 j_summary", "select * from j_summary")
oracle(
    "case_results",
    "d_jest j_parsed j_cases",
    "select run_id, task_id, impl, cast(pos as int) as pos, title, status, failure from j_cases",
)
oracle(
    "report_text",
    "d_jest j_parsed j_v2 j_cases",
    f"""select run_id, 'Test Run: 1970-01-01T00:00:00.000Z' || {NL} || {NL} || {NL} || '# Testing implementation: ' || impl || {NL} || {NL} || {NL}
  || repeat('-', 60) || {NL} || '```bash' || {NL} || coalesce(marks, '') || coalesce(fails, '') || '```' || {NL} || repeat('-', 60) || {NL} || {NL}
  || 'Test Suites: ' || case when passed = total then '1 passed' else '1 failed' end || {NL}
  || 'Tests:       ' || passed || ' passed, ' || (total - passed) || ' failed, ' || total || ' total' || {NL} || {NL} as report
from j_v2 left join (
  select run_id, string_agg(case when status = 'passed' then '✓ ' else '✕ ' end || title || {NL}, '' order by pos) as marks,
    string_agg({NL} || '● ' || title || {NL} || failure || {NL}, '' order by pos) filter (where status <> 'passed' and failure <> '') as fails
  from j_cases group by run_id) using (run_id)
where suite is not null""",
)
oracle(
    "jest_console",
    "d_jest j_parsed j_v1 j_cases",
    f"""select run_id, case when returncode <> 0 and not json_valid(stdout) then {ESC} || '[31mFailed to run tests' || {ESC} || '[0m'
  when returncode <> 0 then coalesce({ESC} || '[31m' || stderr || {ESC} || '[0m', '')
  when suite is null then ''
  else coalesce(body, '') || {NL} || 'Test Suites: ' || case when suite ->> '$.status' = 'passed' then {ESC} || '[32m1 passed' || {ESC} || '[0m'
    else {ESC} || '[31m1 failed' || {ESC} || '[0m' end || {NL}
  || 'Tests:       ' || passed || ' passed, ' || (total - passed) || ' failed, ' || total || ' total' end as console
from j_v1 left join (
  select run_id, string_agg(case when status = 'passed' then {ESC} || '[32m✓' else {ESC} || '[31m✕' end || {ESC} || '[0m ' || title || {NL}
    || case when failure <> '' then {ESC} || '[31m' || failure || {ESC} || '[0m' || {NL} else '' end, '' order by pos) as body
  from j_cases group by run_id) using (run_id)""",
)
oracle(
    "jest_summary_lines",
    "d_jest j_parsed j_v2 j_summary",
    """select task_id, 1 as section, impl as seq, rpad(impl, 20, ' ') || ': ' || passed || '/' || total || ' tests [' || status || ']' as line from j_summary
union all select task_id, 0, cast(n as varchar), case n when 0 then 'Test Summary for ' || task_id when 1 then repeat('=', 40) else '' end
from (select distinct task_id from j_summary), (values (0), (1), (2)) a(n)""",
)

# --- coverage ------------------------------------------------------------------------------------------------------------------------

oracle(
    "jacoco_scan",
    "",
    """select l_returnflag || l_linestatus as report, case when l_suppkey % 10 = 0 then 'org.junit.C' else 'app.C' end || l_partkey as class, 'p' as package,
  cast(l_linenumber * 2 as bigint) as instruction_missed, cast(l_quantity * 3 as bigint) as instruction_covered,
  case when l_partkey % 50 = 0 then null else cast(l_linenumber as bigint) end as branch_missed, cast(l_linenumber as bigint) as branch_covered,
  cast(50 - l_quantity as bigint) as line_missed, cast(l_quantity as bigint) as line_covered,
  case when l_partkey % 50 = 0 then 'counter is not an integer' end as reject_reason from lineitem""",
)
view(
    "d_reports",
    """select l_orderkey % 50 as run_id, l_linenumber = 1 and l_orderkey % 50 % 7 = 3 as bad, l_suppkey % 10 = 0 as framework,
  l_linenumber * 2 as im, l_quantity * 3 as ic, l_linenumber as bm, 1 as bc, 50 - l_quantity as lm, l_quantity as lc from lineitem""",
)
view(
    "report_sums",
    f"""select run_id, total_instructions, covered_instructions, {pct('covered_instructions', 'total_instructions')} as instruction_coverage,
  total_branches, covered_branches, {pct('covered_branches', 'total_branches')} as branch_coverage,
  total_lines, covered_lines, {pct('covered_lines', 'total_lines')} as line_coverage
from (select run_id, cast(sum(im + ic) as bigint) as total_instructions, cast(sum(ic) as bigint) as covered_instructions,
    cast(sum(bm + bc) as bigint) as total_branches, cast(sum(bc) as bigint) as covered_branches,
    cast(sum(lm + lc) as bigint) as total_lines, cast(sum(lc) as bigint) as covered_lines
  from d_reports where not framework group by run_id having not bool_or(bad))""",
)
view(
    "bad_reports",
    """select run_id, 'counter is not an integer' as reject_reason, count(*) as rejected_rows from d_reports where bad and not framework group by run_id""",
)
oracle("jacoco_report_totals", "d_reports report_sums", "select * from report_sums")
oracle("jacoco_rejected_reports", "d_reports bad_reports", "select * from bad_reports")
oracle(
    "coverage_of_rejected_reports",
    "d_runs g_runs d_reports report_sums bad_reports",
    """select g.run_id, task_id, impl, case when b.run_id is null then status else 'FAILED_TO_RUN' end as status, coalesce(reject_reason, error) as error,
  c.* exclude (run_id) from g_runs g left join bad_reports b on b.run_id = g.run_id and status = 'PASSED'
left join report_sums c on c.run_id = g.run_id and status = 'PASSED' and b.run_id is null""",
)
oracle("jacoco_totals", "d_jacoco cov cov_pct", "select * from cov_pct")
oracle(
    "attach_coverage",
    "d_runs g_runs d_jacoco cov cov_pct",
    """select g.run_id, task_id, impl, status, c.* exclude (run_id) from g_runs g left join cov_pct c on c.run_id = g.run_id and status = 'PASSED'""",
)
oracle("overall_coverage", "d_runs g_runs d_jacoco cov overall", "select * from overall")


def numbered(rows: list[tuple[int, int, str]]) -> str:
    return " union all ".join(
        f"select {section} as section, cast({seq} as bigint) as seq, {line} as line" for section, seq, line in rows
    )


_COVERAGE = ["'Code Coverage Report'", "repeat('=', 19)", "''", "'Overall Coverage Metrics:'", "repeat('-', 24)"] + [
    f"(select '{label}: ' || printf('%.2f%%', {column}) from overall)"
    for label, column in (
        ("Overall Coverage", "overall_coverage"), ("Total Instruction Coverage", "instruction_coverage"),
        ("Total Branch Coverage", "branch_coverage"), ("Total Line Coverage", "line_coverage"),
    )
] + ["''"]
oracle(
    "coverage_lines",
    "d_runs g_runs d_jacoco cov overall",
    numbered([(0, i, line) for i, line in enumerate(_COVERAGE)]),
)

# --- summaries -------------------------------------------------------------------------------------------------------------------------

_COUNTS = """count(*) as total, count(*) filter (where status = 'PASSED') as passed,
  count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'FAILED_TO_RUN') as failed_to_run"""
oracle("status_counts", "d_runs g_runs", f"select {_COUNTS} from g_runs")
oracle("status_counts_by_task", "d_runs g_runs", f"select task_id, {_COUNTS} from g_runs group by task_id")
oracle(
    "letter_files",
    "d_runs g_runs mixed",
    "select run_id, file_name from mixed where regexp_matches(file_name, '^[A-Za-z]\\.java$')",
)
oracle(
    "assign_cohort",
    "d_runs g_runs mixed",
    """select run_id, file_name, status, case when length(file_name) <> 6 then null when upper(left(file_name, 1)) between 'A' and 'E' then 'first'
  when upper(left(file_name, 1)) between 'F' and 'J' then 'second' end as cohort from mixed""",
)
oracle(
    "cohort_stats",
    "d_runs g_runs cohorts",
    f"select *, {pct('passed', 'total')} as pass_pct, {pct('failed', 'total')} as fail_pct from cohorts",
)
view(
    "cohort_ranges",
    """select 'c' || s_suppkey as cohort, s_suppkey * 37 % 900 as low, s_suppkey * 37 % 900 + (s_suppkey % 10) * (s_suppkey % 17) - 5 as high from supplier""",
)
oracle(
    "assign_cohort_ranges",
    "d_runs g_runs cohort_ranges",
    "select run_id, status, cohort from g_runs left join cohort_ranges on run_id between low and high",
)
oracle(
    "cohort_stats_ranges",
    "d_runs g_runs cohort_ranges",
    f"""select *, {pct('passed', 'total')} as pass_pct, {pct('failed', 'total')} as fail_pct from (
  select cohort, count(run_id) as total, count(*) filter (where status = 'PASSED') as passed,
    count(*) filter (where status in ('FAILED', 'FAILED_TO_RUN')) as failed
  from cohort_ranges left join g_runs on run_id between low and high group by cohort)""",
)
_FIGURES = f"""count(*) as total, count(*) filter (where status = 'PASSED') as passed,
  count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'FAILED_TO_RUN') as failed_to_run,
  {', '.join(f"""{pct(f"sum(covered_{n}) filter (where status = 'PASSED')", f"sum(total_{n}) filter (where status = 'PASSED')")} as {k}_coverage"""
    for k, n in (("instruction", "instructions"), ("branch", "branches"), ("line", "lines")))} from covered"""
view(
    "covered",
    """select g.*, c.* exclude (run_id), case when impl <= 'E' then 'first' when impl <= 'J' then 'second' end as cohort
from g_runs g left join cov c on c.run_id = g.run_id""",
)
oracle(
    "all_figures",
    "d_runs g_runs d_jacoco cov covered",
    f"""select 'task' as level, task_id, cast(null as varchar) as cohort, {_FIGURES} group by task_id
union all select 'cohort', null, cohort, {_FIGURES} where cohort is not null group by cohort
union all select 'overall', null, null, {_FIGURES}""",
)
oracle(
    "cohort_pass_rates",
    "d_runs c_runs",
    f"""select cohort, total, passed, failed, {pct('passed', 'total')} as pass_pct, {pct('failed', 'total')} as fail_pct
from (select cohort, count(status) as total, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status <> 'PASS') as failed
  from (values ('first', 'A', 'E'), ('second', 'F', 'J')) c(cohort, lo, hi) left join c_runs on impl between lo and hi group by cohort)""",
)
oracle(
    "latest_result",
    "d_runs g_runs",
    "select * from g_runs where run_id in (select max(run_id) from g_runs group by task_id, impl)",
)
ORACLES["latest_result_merged"] = ORACLES["latest_result"]
oracle(
    "log_history",
    "d_runs g_runs",
    """select impl, run_id, status, prev as previous_status, prev is not null and prev <> status as changed
from (select *, lag(status) over (partition by impl order by run_id) as prev from g_runs)""",
)
oracle(
    "log_totals",
    "d_runs g_runs",
    """select impl, count(*) as entries, max(run_id) as latest, max_by(status, run_id) as latest_status from g_runs group by impl""",
)


def _count(where: str) -> str:
    return f"(select count(*) from g_runs{' where status = ' + quoted(where) if where else ''})"


_SUMMARY = [(0, 0, "'Test Execution Summary'"), (0, 1, "repeat('=', 21)"), (0, 2, "''")]
_SUMMARY += [
    (1, 0, "'Overall Results (All Files):'"),
    (1, 1, "repeat('-', 27)"),
    (1, 2, f"'Total files tested: ' || {_count('')}"),
    (1, 3, f"'Passed: ' || {_count('PASSED')}"),
    (1, 4, f"'Failed: ' || {_count('FAILED')}"),
    (1, 5, f"'Failed to Run: ' || {_count('FAILED_TO_RUN')}"),
    (1, 6, "''"),
    (2, 0, "'Model Comparison Statistics (Letter Files Only):'"),
    (2, 1, "repeat('-', 44)"),
    (2, 2, "''"),
    (4, 0, "'Detailed Results:'"),
    (4, 1, "repeat('-', 16)"),
]
for _i, (_cohort, _title) in enumerate((("first", "First Model Tests (A-E):"), ("second", "Second Model Tests (F-J):"))):
    _from = f"from cohorts where cohort = '{_cohort}'"
    _SUMMARY += [
        (3, _i * 6, f"'{_title}'"),
        (3, _i * 6 + 1, "repeat('-', 24)"),
        (3, _i * 6 + 2, f"(select 'Total tests: ' || total {_from})"),
        (3, _i * 6 + 3, f"(select 'Passed: ' || passed {_from})"),
        (3, _i * 6 + 4, f"(select 'Failed/Failed to Run: ' || failed {_from})"),
        (3, _i * 6 + 5, f"(select 'Pass Rate: ' || printf('%.2f%%', {pct('passed', 'total')}) {_from})"),
    ]
oracle(
    "summary_lines",
    "d_runs g_runs cohorts",
    numbered(_SUMMARY)
    + """ union all select 5, run_id, case status when 'PASSED' then '✅' when 'FAILED' then '❌' else '⚠️' end || ' ' || impl || '.java: ' || status
from g_runs""",
)

# --- written and read back -----------------------------------------------------------------------------------------------------------

ORACLES["write_programs"] = ORACLES["render_all"]


def written(name: str, lines: str) -> None:
    """The lines alone; files do not keep the sort keys."""
    ORACLES[name] = f"select line from ({ORACLES[lines]})"


written("write_summary", "summary_lines")
written("write_coverage", "coverage_lines")
oracle(
    "append_batches", "d_runs", "select run_id, phase, stdout, impl || '_tests' as target, phase as batch from d_runs"
)
oracle("append_logs", "d_runs", "select run_id, phase, stdout, impl || '_tests' as target from d_runs")

# --- logs and texts ----------------------------------------------------------------------------------------------------------------------

ANSI_PY = r"'\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])'"


def ansi_js(text: str) -> str:
    out = text
    for pattern in (
        r"\x1b\[[0-9;]*m",
        r"\x1b\[([0-9]{1,2}(;[0-9]{1,2})*)?[m|K]",
        r"[\x{1b}\x{9b}][\[()#;?]*(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-ORZcf-nqry=><]",
    ):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return out


def ansi_py(text: str) -> str:
    return f"regexp_replace({text}, {ANSI_PY}, '', 'g')"


oracle("strip_ansi", "d_logs", f"select run_id, {ansi_py('log')} as clean from d_logs")
oracle("strip_ansi_js", "d_logs", f"select run_id, {ansi_js('log')} as clean from d_logs")
oracle(
    "log_line_filter",
    "d_logs",
    f"select run_id, array_to_string(list_filter(string_split(log, {NL}), lambda l: not starts_with(l, '/Users/me/')), {NL}) as kept from d_logs",
)
_MARKED = f"replace(replace(log, ' the ', ' ' || {NL} || ' ' || {ESC} || '[32m✓' || {ESC} || '[0m   '), ' of ', chr(9) || {NL} || '✓')"
_CLEAN = ansi_js(f"trim(l, {SPACE})")
oracle(
    "report_lines",
    "d_logs",
    f"""select run_id, array_to_string(list_transform(list_transform(string_split({_MARKED}, {NL}), lambda l: {_CLEAN}),
  lambda c: case when starts_with(c, '✓') then '✓ ' || trim(substr(c, 2), {SPACE}) else c end), {NL}) as lines from d_logs""",
)
oracle(
    "report_line_table",
    "d_logs",
    f"""select run_id, cast(pos - 1 as int) as pos, line from (select run_id, unnest(string_split(log, {NL})) as line,
  generate_subscripts(string_split(log, {NL}), 1) as pos from d_logs)""",
)
oracle(
    "python_report",
    "d_logs",
    f"""select run_id, 'Test Report for m.v' || run_id || {NL} || repeat('=', 50) || {NL} || {NL} || 'TEST RESULTS:' || {NL} || repeat('-', 20) || {NL}
  || {ansi_py('log')} || {NL} || 'COVERAGE REPORT:' || {NL} || repeat('-', 20) || {NL} || {ansi_py('log')} as report from d_logs""",
)
oracle(
    "java_report",
    "d_runs g_runs",
    f"""select run_id, impl || '.txt' as report_file, 'Test Results for ' || impl || '.java' || {NL} || 'Timestamp: 1970-01-01 00:00:00' || {NL}
  || 'Status: ' || status || {NL} || {NL} || 'Test Output:' || {NL} || output
  || case when error is null then '' else {NL} || 'Errors:' || {NL} || error end as report from g_runs""",
)
oracle(
    "name_and_pad",
    "",
    """select doc_id, source as stem_java, source || '.java.x.js' || lang as stem_python, source || '.java.x' || lang || '.py' as stem_js, source as stem_dir,
  rpad(source, 20, ' ') as padded, case when length(text) >= 20 then text else rpad(text, 20, ' ') end as whole,
  printf('%.2f%%', cast(doc_id as double) / cast(n_chars as double) * 100) as pct,
  case doc_id % 3 when 0 then '✅' when 1 then '❌' else '⚠️' end as icon,
  case doc_id % 3 when 0 then '[PASS]' when 1 then '[FAIL]' else '[FAILED_TO_RUN]' end as icon_text,
  case when doc_id % 2 = 0 then null else lang end as filled from documents""",
)


ORACLES["write_reports"] = ORACLES["java_report"]


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
