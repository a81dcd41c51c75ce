"""What the code-analysis queries must return, stated in SQL over the columns the sources derive from."""

_BASE = """
WITH p AS (
  SELECT p_partkey AS k, p_name AS name, p_brand AS project, CAST(substr(p_brand, 7) AS INTEGER) AS b, p_size AS s,
    CAST(p_partkey % 17 AS INTEGER) AS f,
    CASE WHEN p_partkey % 2 = 0 THEN 'mod' ELSE 'pkg/mod' END || p_partkey || '.py' AS module,
    'mod' || p_partkey AS stem
  FROM part),
fl AS (
  SELECT k, project, f, module AS part_module, stem AS part_stem, 'flows/flow' || k || '.py' AS module, 'flow' || k AS stem
  FROM supplier JOIN p ON s_suppkey = k),
ts AS (
  SELECT k, project, f, module AS part_module, stem AS part_stem, 'checks/test_flow' || k || '.py' AS module,
    'test_flow' || k AS stem
  FROM customer JOIN p ON c_custkey = k),
fw AS (SELECT * FROM (VALUES
  (0, 'langchain', 'langchain', 'create_react_agent', 'create_react_agent', 'create_react_agent(llm, tools)', NULL,
     'LangChain agent created via create_react_agent', 0),
  (1, 'langgraph', 'langgraph.graph', 'StateGraph', 'StateGraph', 'StateGraph(dict)', 'StateGraph',
     'LangGraph agent created via StateGraph', 1),
  (2, 'crewai', 'crewai', 'Agent', 'Agent', 'Agent(llm, tools)', 'Agent',
     'CrewAI agent created via Agent constructor', 1),
  (3, 'autogen', '', 'autogen', 'AssistantAgent', 'AssistantAgent(llm)', 'autogen', NULL, 0),
  (4, 'semantic_kernel', 'semantic_kernel', 'ChatCompletionAgent', 'ChatCompletionAgent', 'ChatCompletionAgent(llm)',
     'ChatCompletionAgent', 'Semantic Kernel agent created via ChatCompletionAgent', 1),
  (5, 'llama_index', 'llama_index.core', 'ReActAgent', 'ReActAgent', 'ReActAgent(llm)', 'ReActAgent',
     'LlamaIndex agent created via ReActAgent', 1),
  (6, 'haystack', 'haystack.components', 'Agent', 'Agent', 'Agent(llm)', 'Agent',
     'Haystack agent created via Agent component', 1),
  (7, 'metagpt', 'metagpt.roles', 'Role', 'Role', 'Role(llm)', 'Role', 'MetaGPT agent created via Role', 1),
  (8, 'swarm', 'swarm', 'Agent', 'Agent', 'Agent(llm)', 'Agent', 'OpenAI Swarm agent created via Agent constructor', 1),
  (9, 'openai_agents_sdk', 'agents', 'Agent,Runner', 'run_sync', 'run_sync(llm)', 'Runner',
     'OpenAI Agents SDK agent via run_sync', 0),
  (10, 'dspy', '', 'dspy', 'ReAct', 'ReAct(llm)', 'dspy', NULL, 0),
  (11, 'langroid', '', 'langroid', 'ChatAgent', 'ChatAgent(llm)', NULL, NULL, 0),
  (12, 'camel', 'camel.societies', 'ChatAgent', 'ChatAgent', 'ChatAgent(llm)', 'ChatAgent',
     'CAMEL agent created via ChatAgent', 1),
  (13, 'letta', 'letta_client', 'Letta', 'create', 'create(name)', NULL, 'Letta agent created via client.agents.create', 0),
  (14, 'mcp', 'mcp.server', 'Server', 'Server', 'Server(''x'')', 'Server', NULL, 1),
  (15, 'fastmcp', 'fastmcp', 'FastMCP', 'FastMCP', 'FastMCP(''x'')', 'FastMCP', NULL, 1),
  (16, 'claude_agent_sdk', 'claude_agent_sdk', 'Agent', 'Agent', 'Agent(llm, tools)', 'Agent',
     'Claude Agent SDK agent created via Agent constructor', 1)
  ) v(f, framework, origin, names, callee, signature, receiver, made, ctor)),
d AS (SELECT DISTINCT project, framework FROM p JOIN fw USING (f)),
relevant AS (
  SELECT DISTINCT project FROM d WHERE framework NOT IN ('semantic_kernel', 'haystack', 'metagpt', 'dspy')),
has_mcp AS (SELECT project FROM d WHERE framework = 'mcp'),
toolmods AS (
  SELECT p.*, CASE WHEN f = 15 AND project IN (SELECT project FROM has_mcp) THEN 'mcp' ELSE framework END AS own
  FROM p JOIN fw USING (f) WHERE framework NOT IN ('semantic_kernel', 'haystack', 'metagpt', 'dspy')),
made AS (
  SELECT p.*, framework, made AS description, signature, receiver, ctor FROM p JOIN fw USING (f) WHERE made IS NOT NULL),
binds AS (SELECT * FROM (VALUES
  (0, 'bind_tools', 'bind_tools(<expr>)'), (1, 'add_tool', 'add_tool(<expr>)'), (2, 'describe', 'describe(''a'', limit)')
  ) v(r, name, signature)),
calls AS (
  SELECT project, module, stem || '.lookup_' || k AS function, 'reduce' AS method_name, 'reduce(max, query)' AS method_signature,
    'functools' AS receiver_type, false AS is_constructor_call, false AS is_application_call, 11 AS start_line FROM p
  UNION ALL SELECT project, module, stem || '.Search' || k || '.run', 'lookup_' || k, 'lookup_' || k || '(query)', NULL, false, true, 16 FROM p
  UNION ALL SELECT project, module, stem || '.helper_' || k, 'str', 'str(value)', NULL, false, false, 22 FROM p
  UNION ALL SELECT project, module, stem || '.helper_' || k, 'len', 'len(<expr>)', NULL, false, false, 25 FROM p
  UNION ALL SELECT project, module, stem || '.build_' || k, callee, signature, receiver, ctor = 1, false, 28 FROM p JOIN fw USING (f)
  UNION ALL SELECT project, module, stem || '.build_' || k, binds.name, signature, NULL, false, false, 29 FROM p JOIN binds ON s % 3 = r
  UNION ALL SELECT project, module, stem || '.again_' || k, 'build_' || k, 'build_' || k || '(llm)', NULL, false, true, 33 FROM p
  UNION ALL SELECT project, module, stem || '.run_' || k, 'join', 'join(<expr>, folder)', NULL, false, false, 5 FROM fl
  UNION ALL SELECT project, module, stem || '.run_' || k, 'str', 'str(build_' || k || ')', NULL, false, false, 5 FROM fl
  UNION ALL SELECT project, module, stem || '.Flow' || k || '.go', 'build_' || k, 'build_' || k || '(None)', NULL, false, false, 9 FROM fl
  UNION ALL SELECT project, module, stem || '.TestFlow' || k || '.setUp', 'MagicMock', 'MagicMock()', NULL, true, false, 7 FROM ts
  UNION ALL SELECT project, module, stem || '.TestFlow' || k || '.check', 'assertEqual', 'assertEqual(value, 1)', NULL, false, false, 10 FROM ts
  UNION ALL SELECT project, module, stem || '.TestFlow' || k || '.test_build', 'build_' || k, 'build_' || k || '(None)', NULL, false, false, 14 FROM ts
  UNION ALL SELECT project, module, stem || '.TestFlow' || k || '.test_build', 'check', 'check(' || n || ')', NULL, false, true, 14 + n
    FROM ts CROSS JOIN (VALUES (1), (2)) v(n)
  UNION ALL SELECT project, module, stem || '.TestFlow' || k || '.test_build', 'assertTrue', 'assertTrue(agent)', NULL, false, false, 17 FROM ts
  UNION ALL SELECT project, module, stem || '.plain_' || k, 'isinstance', 'isinstance(value, int)', NULL, false, false, 25 FROM ts
  UNION ALL SELECT project, module, stem || '.test_alone_' || k, 'plain_' || k, 'plain_' || k || '(ready_' || k || ')', NULL, false, true, 29 FROM ts
  UNION ALL SELECT project, module, stem || '.test_alone_' || k, 'plain_' || k, 'plain_' || k || '(value)', NULL, false, true, 32 FROM ts),
defs AS (
  SELECT project, module, stem, k, v.* FROM p CROSS JOIN (VALUES
    ('lookup_', true, '', false, 9, 11, 3, 1, 1), ('run', false, 'Search', false, 15, 16, 2, 1, 1),
    ('helper_', true, '', false, 18, 25, 6, 6, 5), ('build_', true, '', false, 27, 30, 4, 1, 1),
    ('again_', true, '', false, 32, 33, 2, 1, 1)) v(fn, keyed, cls, is_test, start_line, end_line, ncloc, complexity, test_complexity)
  UNION ALL SELECT project, module, stem, k, v.* FROM fl CROSS JOIN (VALUES
    ('run_', true, '', false, 4, 5, 2, 1, 1), ('go', false, 'Flow', false, 8, 9, 2, 1, 1)) v
  UNION ALL SELECT project, module, stem, k, v.* FROM ts CROSS JOIN (VALUES
    ('ready_', true, '', true, 21, 22, 2, 1, 1), ('plain_', true, '', false, 24, 26, 3, 1, 2),
    ('test_alone_', true, '', true, 28, 32, 5, 3, 4), ('setUp', false, 'TestFlow', true, 6, 7, 2, 1, 1),
    ('check', false, 'TestFlow', true, 9, 10, 2, 1, 1), ('test_build', false, 'TestFlow', true, 13, 18, 6, 1, 2)) v),
fns AS (
  SELECT *, fn || CASE WHEN keyed THEN CAST(k AS VARCHAR) ELSE '' END AS name,
    stem || CASE WHEN cls <> '' THEN '.' || cls || k ELSE '' END || '.' || fn || CASE WHEN keyed THEN CAST(k AS VARCHAR) ELSE '' END
      AS qualified_name
  FROM defs),
uniq AS (
  SELECT project, name, min(qualified_name) AS qualified_name FROM fns GROUP BY 1, 2 HAVING count(DISTINCT qualified_name) = 1),
edges AS (
  SELECT DISTINCT c.project, c.function AS src, coalesce(u.qualified_name, c.method_name) AS dst
  FROM calls c LEFT JOIN uniq u ON u.project = c.project AND u.name = c.method_name),
callers AS (
  SELECT m.project, m.framework, 'run_' || fl.k AS name, fl.module AS qualified_module_name, fl.stem || '.run_' || fl.k AS method_signature,
    'Calling agent that invokes: ' || m.stem || '.build_' || m.k AS description
  FROM fl JOIN made m ON m.k = fl.k
  UNION ALL
  SELECT project, framework, 'again_' || k, module, stem || '.again_' || k, 'Calling agent that invokes: ' || stem || '.build_' || k
  FROM made WHERE b % 2 = 0),
uses AS (
  SELECT ts.*, m.framework, m.stem || '.build_' || m.k AS agent_signature FROM ts JOIN made m ON m.k = ts.k WHERE ts.k % 2 = 0)
"""

_TOOL = """'{kind}' AS tool_type, {text} AS tool_description, {method} AS tool_binding_method, module AS tool_binding_module"""

_CALLS = """
WITH RECURSIVE calls AS (
  SELECT p_brand AS project, 'f' || p_partkey AS src,
         'f' || coalesce(lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey), min(p_partkey) OVER (PARTITION BY p_brand)) AS dst FROM part
  UNION SELECT p_brand, 'f' || p_partkey, 'hub ' || p_brand FROM part
  UNION SELECT p_brand, 'hub ' || p_brand, 'f' || min(p_partkey) FROM part GROUP BY p_brand)"""

SQL = {
    "modules": _BASE + """
SELECT project, module AS qualified_name, '/src/' || project || '/' || module AS file_path, is_test FROM (
  SELECT project, module, false AS is_test FROM p UNION ALL SELECT project, module, false FROM fl
  UNION ALL SELECT project, module, true FROM ts)""",
    "imports": _BASE + """
SELECT project, module, CAST(o AS BIGINT) AS ordinal, from_statement, names FROM (
  SELECT project, module, 0 AS o, '' AS from_statement, 'functools' AS names FROM p
  UNION ALL SELECT project, module, 1, origin, names FROM p JOIN fw USING (f)
  UNION ALL SELECT project, module, 2, '', stem FROM p WHERE b % 2 = 0
  UNION ALL SELECT project, module, 0, '', 'os' FROM fl
  UNION ALL SELECT project, module, 1, replace(replace(part_module, '.py', ''), '/', '.'), 'build_' || k FROM fl
  UNION ALL SELECT project, module, 0, '', 'unittest' FROM ts
  UNION ALL SELECT project, module, 1, 'unittest.mock', 'patch' FROM ts
  UNION ALL SELECT project, module, 2, replace(replace(part_module, '.py', ''), '/', '.'), 'build_' || k FROM ts)""",
    "classes": _BASE + """
SELECT project, module, qualified_name, base, docstring, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, is_test_class FROM (
  SELECT project, module, stem || '.Search' || k AS qualified_name,
    CASE b % 4 WHEN 0 THEN 'BaseTool' WHEN 1 THEN 'FunctionTool' WHEN 2 THEN 'Tool' ELSE 'object' END AS base,
    'Search ' || name || '.' AS docstring, 13 AS s, 16 AS e, false AS is_test_class FROM p
  UNION ALL SELECT project, module, stem || '.Flow' || k, '', NULL, 7, 9, false FROM fl
  UNION ALL SELECT project, module, stem || '.TestFlow' || k, 'unittest.TestCase', NULL, 5, 18, true FROM ts)""",
    "functions": _BASE + """
SELECT project, module, qualified_name, CASE WHEN cls = '' THEN 'function' ELSE 'method' END AS kind, is_test,
  CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(ncloc AS BIGINT) AS ncloc,
  CAST(complexity AS BIGINT) AS complexity, CAST(test_complexity AS BIGINT) AS test_complexity FROM fns""",
    "call_sites": _BASE + """
SELECT project, module, function, method_name, method_signature, receiver_type, is_constructor_call, is_application_call,
  CAST(start_line AS BIGINT) AS start_line FROM calls""",
    "framework_detect": _BASE + "SELECT project, framework FROM d",
    "decorator_tools": _BASE + """
SELECT project, module || '.lookup_' || k AS tool_id, CASE WHEN s % 6 = 1 THEN 'openai_agents_sdk' ELSE own END AS framework,
  'lookup_' || k AS tool_name, """ + _TOOL.format(kind="decorator_tool", text="'Look up ' || name || '.'", method="stem || '.lookup_' || k") + """
FROM toolmods WHERE s % 6 IN (0, 1, 2, 3)""",
    "class_tools": _BASE + """,
hints AS (SELECT * FROM (VALUES (1, 'langchain'), (2, 'langgraph'), (3, 'crewai'), (4, 'llama_index'), (5, 'openai_agents_sdk'),
  (6, 'autogen'), (7, 'langroid'), (8, 'camel'), (9, 'letta')) v(pos, framework)),
based AS (SELECT *, CASE b % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END AS low FROM toolmods WHERE b % 4 < 3),
alone AS (
  SELECT k, min(pos) AS pos FROM based JOIN d USING (project) JOIN hints ON hints.framework = d.framework AND pos >= low GROUP BY k)
SELECT project, stem || '.Search' || based.k AS tool_id, coalesce(h.framework, a.framework, 'unknown') AS framework,
  'Search' || based.k AS tool_name, """ + _TOOL.format(kind="class_tool", text="'Search ' || name || '.'", method="stem || '.Search' || based.k") + """
FROM based LEFT JOIN hints h ON h.framework = own AND h.pos >= low LEFT JOIN alone ON alone.k = based.k
LEFT JOIN hints a ON a.pos = alone.pos""",
    "lambda_tools": _BASE + """,
found AS (SELECT p.*, 5 AS line FROM p WHERE b % 3 = 0 UNION ALL SELECT p.*, 29 FROM p WHERE s % 3 = 1)
SELECT project, module || '.lambda_tool_' || line AS tool_id,
  CASE WHEN f IN (4, 6, 7, 10) THEN 'unknown' WHEN f = 15 THEN 'mcp' ELSE framework END AS framework,
  'lambda_tool_' || line AS tool_name, """ + _TOOL.format(kind="lambda_tool", text="'Lambda tool at line ' || line", method="'lambda_tool_' || line") + """
FROM found JOIN fw USING (f) JOIN relevant USING (project)""",
    "mcp_tools": _BASE + """
SELECT project, module || '.lookup_' || k AS tool_id, 'mcp' AS framework, 'lookup_' || k AS tool_name,
  """ + _TOOL.format(kind="mcp_tool", text="'Look up ' || name || '.'", method="stem || '.lookup_' || k") + """
FROM toolmods WHERE f = 14 AND s % 6 IN (3, 5)""",
    "claude_sdk_tools": _BASE + """
SELECT project, module || '.lookup_' || k AS tool_id, 'claude_agent_sdk' AS framework, 'lookup_' || k AS tool_name,
  """ + _TOOL.format(kind="decorator_tool", text="'Look up ' || name || '.'", method="stem || '.lookup_' || k") + """
FROM toolmods WHERE f = 16 AND s % 6 <> 4""",
    "factory_agents": _BASE + """
SELECT project, framework, 'build_' || k AS name, module AS qualified_module_name, stem || '.build_' || k AS method_signature, description,
  CAST(4 AS BIGINT) AS ncloc, CAST(1 AS BIGINT) AS complexity, CAST(ctor AS BIGINT) AS number_of_objects_created FROM made""",
    "calling_agents": _BASE + """
SELECT *, CAST(2 AS BIGINT) AS ncloc, CAST(1 AS BIGINT) AS complexity FROM callers""",
    "agent_tools": _BASE + """
SELECT project, framework, tool_name, 'function_tool' AS tool_type, stem || '.build_' || k AS tool_binding_method,
  module AS tool_binding_module FROM (
  SELECT *, 'lookup_' || k AS tool_name FROM made WHERE f = 16
  UNION ALL SELECT *, 'helper_' || k FROM made WHERE f IN (0, 16) AND s % 3 = 0
  UNION ALL SELECT *, 'lambda y: y' FROM made WHERE f IN (0, 16) AND s % 3 = 1)""",
    "agent_call_details": _BASE + """
SELECT m.project, m.module AS qualified_module_name, CASE WHEN c.is_constructor_call THEN 'constructor' ELSE 'library' END AS call_kind,
  c.method_signature AS qualified_method_signature, coalesce(c.receiver_type, '') AS qualified_class_name,
  CAST(c.start_line AS BIGINT) AS line_number
FROM made m JOIN calls c ON c.project = m.project AND c.module = m.module AND c.function = m.stem || '.build_' || m.k""",
    "agent_tests": _BASE + """
SELECT project, module AS qualified_module_name, stem || '.TestFlow' || k AS qualified_class_name,
  stem || '.TestFlow' || k || '.test_build' AS method_signature, 'patch(''os.getenv'')' AS annotation, CAST(6 AS BIGINT) AS ncloc,
  agent_signature, framework FROM uses""",
    "test_complexity": _BASE + """
SELECT project, qualified_name, module AS qualified_module_name, CAST(ncloc AS BIGINT) AS ncloc,
  CAST(test_complexity AS BIGINT) AS cyclomatic_complexity, CAST(ctor AS BIGINT) AS number_of_constructor_call,
  CAST(lib AS BIGINT) AS number_of_library_call, CAST(app AS BIGINT) AS number_of_application_call,
  CAST(mock AS BIGINT) AS number_of_mocking_used, CAST(asserts AS BIGINT) AS number_of_assertions,
  CAST(fixtures AS BIGINT) AS number_of_fixtures_used, CAST(helpers AS BIGINT) AS number_of_helper_methods
FROM fns JOIN (VALUES ('setUp', 1, 1, 0, 1, 0, 1, 0), ('check', 0, 1, 0, 0, 1, 1, 0), ('test_build', 0, 2, 2, 1, 2, 1, 0),
  ('ready_', 0, 0, 0, 0, 0, 0, 0), ('test_alone_', 0, 0, 2, 0, 1, 1, 2)) v(fn, ctor, lib, app, mock, asserts, fixtures, helpers) USING (fn)""",
    "test_fixtures": _BASE + """
SELECT project, module, CAST(o AS BIGINT) AS function_ordinal, o > 2 AS is_setup, false AS is_teardown,
  CASE WHEN o > 2 THEN stem || '.TestFlow' || k ELSE '' END AS qualified_class_name,
  CASE WHEN o > 2 THEN 'setUp(self)' ELSE 'ready_' || k || '()' END AS method_signature, CAST(2 AS BIGINT) AS ncloc
FROM ts CROSS JOIN (VALUES (2), (3), (4), (5)) v(o)""",
    "test_helpers": _BASE + """
SELECT project, module, CAST(2 AS BIGINT) AS function_ordinal, 'plain_' || k || '(value)' AS method_signature,
  CAST(3 AS BIGINT) AS ncloc, CAST(1 AS BIGINT) AS number_of_assertions FROM ts CROSS JOIN (VALUES (1), (2)) v(n)""",
    "test_assertions": _BASE + """
SELECT project, module, v.* FROM ts CROSS JOIN (VALUES ('equality', 'assertEqual', 'assertEqual(value, 1)'),
  ('truthiness', 'assertTrue', 'assertTrue(agent)'), ('nullness', 'assert', 'assert agent is not None'),
  ('type', 'assert', 'assert isinstance(value, int)'), ('equality', 'assert', 'assert value == 1')
  ) v(assertion_type, assertion_name, assertion_code)""",
    "call_graph_edges": _BASE + "SELECT project, src, dst FROM edges",
    "call_graph_degree": _BASE + """
SELECT n.project, n.node, CAST(count(e.dst) AS BIGINT) AS callees
FROM (SELECT project, src AS node FROM edges UNION SELECT project, dst FROM edges) n
LEFT JOIN edges e ON e.project = n.project AND e.src = n.node GROUP BY 1, 2""",
    "call_hops": _CALLS + """,
ways AS (SELECT 'callees' AS direction, 3 AS most, project, src AS node, dst AS next FROM calls
         UNION SELECT 'callers', 2, project, dst, src FROM calls),
walk AS (
  SELECT DISTINCT w.direction, w.most, c.project, c.src AS start, c.src AS node, 0 AS hops FROM calls c CROSS JOIN (SELECT DISTINCT direction, most FROM ways) w
  UNION SELECT r.direction, r.most, r.project, r.start, w.next, r.hops + 1
  FROM walk r JOIN ways w ON w.direction = r.direction AND w.project = r.project AND w.node = r.node WHERE r.hops < r.most)
SELECT project, direction, start, node, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY ALL""",
    "call_surroundings": _CALLS + """,
steps AS (SELECT project, src AS node, dst AS next, 1 AS way FROM calls UNION SELECT project, dst, src, 2 FROM calls),
walk AS (
  SELECT DISTINCT project, dst AS start, dst AS node, w AS way, 0 AS hops FROM calls, (VALUES (1), (2)) v(w) WHERE starts_with(src, 'hub')
  UNION SELECT r.project, r.start, s.next, r.way, r.hops + 1 FROM walk r JOIN steps s ON s.project = r.project AND s.node = r.node AND s.way = r.way WHERE r.hops < 2),
near AS (SELECT DISTINCT project, start, node FROM walk)
SELECT c.project, a.start, count(*) AS edges, count(DISTINCT c.src) AS callers
FROM calls c JOIN near a ON a.project = c.project AND a.node = c.src JOIN near b ON b.project = c.project AND b.node = c.dst AND b.start = a.start GROUP BY ALL""",
    "unique_names": _BASE + "SELECT project, name, qualified_name FROM uniq",
    "enclosing_functions": _BASE + """
SELECT project, module, what, CAST(line AS BIGINT) AS line, CAST(o AS BIGINT) AS function_ordinal FROM (
  SELECT project, module, 'lambda' AS what, 29 AS line, 2 AS o FROM p WHERE s % 3 = 1
  UNION ALL SELECT project, module, 'assert', v.* FROM ts CROSS JOIN (VALUES (18, 5), (25, 1), (31, 2)) v(line, o))""",
    "test_methods": _BASE + """
SELECT project, qualified_name, module FROM fns WHERE fn IN ('test_alone_', 'setUp', 'check', 'test_build')""",
    "decorated_methods": _BASE + """
SELECT project, stem || '.lookup_' || k AS qualified_name, module FROM p WHERE s % 6 <> 4
UNION ALL SELECT project, stem || '.ready_' || k, module FROM ts""",
    "classes_by_criteria": _BASE + """
SELECT project, stem || '.Search' || k AS qualified_name, module FROM p
UNION ALL SELECT project, stem || '.Flow' || k, module FROM fl""",
    "test_module_predicate": """
WITH u AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/') AS parts FROM pages),
n AS (SELECT page_id, parts[-1] AS name, lower(array_to_string(parts[1:len(parts) - 1], '/')) AS folders FROM u)
SELECT page_id, starts_with(name, 'test_') OR ends_with(name, '_test.py') OR starts_with(name, 'spec_')
  OR ends_with(name, '_spec.py') OR name = 'conftest.py' OR contains(folders, 'test') AS is_test FROM n""",
    "application_report": _BASE + """
SELECT w.project, w.frameworks, coalesce(a.n, 0) AS agents, coalesce(t.n, 0) AS tests
FROM (SELECT project, string_agg(framework, ',' ORDER BY framework) AS frameworks FROM d GROUP BY 1) w
LEFT JOIN (SELECT project, count(*) AS n FROM (SELECT project FROM made UNION ALL SELECT project FROM callers) GROUP BY 1) a USING (project)
LEFT JOIN (SELECT project, count(*) AS n FROM uses GROUP BY 1) t USING (project)""",
}

# The ordered walk over binding calls of each project: every call takes the first helper nobody took.
SQL["function_tools"] = _BASE.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + """,
args AS (SELECT project, k, row_number() OVER (PARTITION BY project ORDER BY module) AS n FROM p WHERE s % 3 = 0),
wishes AS (
  SELECT a.project, a.n, list(t.module ORDER BY t.module) AS modules FROM args a
  JOIN toolmods t ON t.project = a.project AND contains('[helper_' || a.k || ']', 'helper_' || t.k) GROUP BY 1, 2),
walk AS (
  SELECT DISTINCT project, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken FROM args
  UNION ALL
  SELECT a.project, a.n, list_concat(taken, list_filter(coalesce(modules, []), lambda m: NOT list_contains(taken, m))[1:1])
  FROM walk w JOIN args a ON a.project = w.project AND a.n = w.n + 1 LEFT JOIN wishes h ON h.project = a.project AND h.n = a.n),
last AS (SELECT project, unnest(taken) AS module FROM walk QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC) = 1)
SELECT project, module || '.helper_' || k AS tool_id, own AS framework, 'helper_' || k AS tool_name,
  """ + _TOOL.format(kind="function_tool", text="CAST(NULL AS VARCHAR)", method="stem || '.helper_' || k") + """
FROM last JOIN toolmods USING (project, module)"""

SQL["detected_tools"] = f"""
WITH d1 AS ({SQL["decorator_tools"]}), d2 AS ({SQL["class_tools"]}), d3 AS ({SQL["function_tools"]}), d4 AS ({SQL["lambda_tools"]}),
d5 AS ({SQL["mcp_tools"]}), d6 AS ({SQL["claude_sdk_tools"]})
SELECT * FROM d1 UNION ALL BY NAME SELECT * FROM d2 UNION ALL BY NAME SELECT * FROM d3 UNION ALL BY NAME SELECT * FROM d4
UNION ALL BY NAME SELECT * FROM d5 WHERE tool_id NOT IN (SELECT tool_id FROM d1)
UNION ALL BY NAME SELECT * FROM d6 WHERE tool_id NOT IN (SELECT tool_id FROM d1)"""

SQL["merged_tools"] = f"""
WITH t AS ({SQL["detected_tools"]}), a AS ({SQL["agent_tools"]})
SELECT project, framework, tool_name, tool_type, tool_description, tool_binding_method, tool_binding_module FROM t
UNION ALL SELECT project, framework, tool_name, tool_type, NULL, tool_binding_method, tool_binding_module FROM a
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.project = a.project AND t.tool_binding_module = a.tool_binding_module
  AND t.tool_binding_method = a.tool_binding_method AND t.tool_name = a.tool_name)"""

SQL["stored_analysis"] = SQL["functions"]

SQL["report_agents"] = f"""
WITH fa AS ({SQL["factory_agents"]}), ca AS ({SQL["calling_agents"]}),
tl AS (SELECT project, framework, tool_binding_module, tool_binding_method, count(*) AS n FROM ({SQL["agent_tools"]}) GROUP BY ALL),
a AS (SELECT project, name, qualified_module_name, framework, method_signature FROM fa
  UNION ALL SELECT project, name, qualified_module_name, framework, method_signature FROM ca)
SELECT a.project, name, qualified_module_name, a.framework, coalesce(n, 0) AS tools
FROM a LEFT JOIN tl ON tl.project = a.project AND tl.framework = a.framework AND tl.tool_binding_module = a.qualified_module_name
  AND tl.tool_binding_method = a.method_signature"""

SQL["report_tests"] = f"""
SELECT project, qualified_module_name, qualified_class_name, method_signature, count(*) AS agents FROM ({SQL["agent_tests"]}) GROUP BY ALL"""

_VARIANTS = """
WITH v AS (SELECT s_suppkey AS k, s_suppkey % 18 AS v, s_suppkey // 18 % 3 AS shape FROM supplier),
n AS (SELECT *, 'supplier' || k AS project, CASE shape WHEN 2 THEN 'make.Maker' || k || '.build_' || k ELSE 'make.build_' || k END AS qualified_name FROM v)
"""
SQL["agent_variants"] = _VARIANTS + """
SELECT project, framework, 'build_' || k AS name, qualified_name AS method_signature, description FROM n JOIN (VALUES
  (0, 'autogen', 'AutoGen agent created via AssistantAgent'), (1, 'autogen', 'AutoGen agent created via UserProxyAgent'),
  (2, 'autogen', 'AutoGen agent created via ConversableAgent'), (3, 'dspy', 'DSPy agent created via ReAct'),
  (4, 'langroid', 'Langroid agent created via ChatAgent'), (5, 'langroid', 'Langroid agent created via ChatAgentConfig'),
  (6, 'langchain', 'LangChain agent created via AgentExecutor'),
  (7, 'langchain', 'LangChain agent created via RunnablePassthrough.assign() pattern'),
  (8, 'langgraph', 'LangGraph agent created via create_react_agent'), (9, 'llama_index', 'LlamaIndex agent created via FunctionAgent'),
  (10, 'llama_index', 'LlamaIndex agent created via AgentWorkflow'), (11, 'metagpt', 'MetaGPT agent created via ProductManager'),
  (12, 'metagpt', 'MetaGPT agent created via Architect'), (13, 'metagpt', 'MetaGPT agent created via Engineer'),
  (14, 'crewai', 'CrewAI agent created via Agent constructor')) x(v, framework, description) USING (v)"""
SQL["variant_functions"] = _VARIANTS + """
SELECT project, qualified_name, CASE shape WHEN 2 THEN 'method' ELSE 'function' END AS kind FROM n WHERE v <> 17"""

SQL["local_receivers"] = """
SELECT p_brand AS project, 'made/m' || p_partkey || '.py' AS module, 'm' || p_partkey || '.' || scope AS function,
  receiver_expr, kind || p_partkey AS receiver_type, CAST(start_line AS BIGINT) AS start_line
FROM part JOIN (VALUES (0, 'go', 'x', 'Foo', 3), (1, 'go', 'd', 'Foo', 6), (2, 'go', 'x', 'Foo', 3), (2, 'go', 'x', 'Bar', 5),
  (3, 'go', 'x', NULL, 4), (4, 'Box.go', 'x', 'Foo', 3), (4, 'Box.stay', 'x', NULL, 6), (5, 'go', 'x', 'Foo', 3), (6, 'go', 'x', 'Foo', 2),
  (7, 'go', 'b', 'Foo', 5), (7, 'go', 'b', 'Foo', 6), (7, 'go', 'b', NULL, 7), (8, 'go', 'x', NULL, 3), (8, 'go', 'y', 'Foo', 5)
) v(shape, scope, receiver_expr, kind, start_line) ON p_partkey % 9 = shape"""
