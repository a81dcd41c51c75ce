"""Detection rules as data.

Fixed values: framework names, import roots and patterns, constructor and method names, and hint words are
those of the public frameworks; list order is match priority.
"""

from __future__ import annotations

from typing import NamedTuple

UNKNOWN = "unknown"

FRAMEWORKS = (
    "langchain", "langgraph", "crewai", "autogen", "semantic_kernel", "llama_index", "haystack", "metagpt", "swarm",
    "openai_agents_sdk", "dspy", "langroid", "camel", "letta", "mcp", "fastmcp", "claude_agent_sdk",
)

IMPORT_ROOTS = {
    "langchain": (
        "langchain", "langchain_core", "langchain_community", "langchain_openai", "langchain_anthropic",
        "langchain_google_genai", "langchain_mistralai", "langchain_huggingface",
    ),
    "langgraph": ("langgraph",),
    "crewai": ("crewai",),
    "autogen": ("autogen", "autogen_core", "autogen_agentchat"),
    "semantic_kernel": ("semantic_kernel",),
    "llama_index": ("llama_index",),
    "haystack": ("haystack",),
    "metagpt": ("metagpt",),
    "swarm": ("swarm",),
    "openai_agents_sdk": ("agents",),
    "dspy": ("dspy",),
    "langroid": ("langroid",),
    "camel": ("camel",),
    "letta": ("letta", "letta_client"),
    "mcp": (
        "mcp", "mcp.server", "mcp.server.fastmcp", "mcp.server.stdio", "mcp.server.sse", "mcp.types", "mcp.client",
        "mcp.client.stdio", "mcp.client.sse", "mcp.shared",
    ),
    "fastmcp": ("fastmcp",),
    "claude_agent_sdk": ("claude_agent_sdk", "anthropic.agents"),
}

# Frameworks whose tools are looked for, with the import text that marks a module as using them.
TOOL_IMPORTS = {
    "langchain": ("langchain", "langchain_core", "langchain_community"),
    "langgraph": ("langgraph",),
    "crewai": ("crewai",),
    "autogen": ("autogen", "autogen_core", "autogen_agentchat"),
    "llama_index": ("llama_index",),
    "swarm": ("swarm",),
    "openai_agents_sdk": ("agents",),
    "langroid": ("langroid",),
    "camel": ("camel",),
    "letta": ("letta", "letta_client"),
    "mcp": ("mcp", "mcp.server", "mcp.types", "mcp.client"),
    "fastmcp": ("fastmcp",),
    "claude_agent_sdk": ("claude_agent_sdk", "anthropic.agents"),
}

DECORATOR_HINTS = {
    "langchain": ("langchain_tool", "structured_tool", "StructuredTool"),
    "crewai": ("crewai",),
    "llama_index": ("llama_index", "FunctionTool"),
    "openai_agents_sdk": ("function_tool",),
    "autogen": ("autogen",),
    "langroid": ("langroid",),
    "camel": ("camel",),
    "letta": ("letta",),
    "fastmcp": ("fastmcp",),
}

BASE_CLASS_HINTS = {
    "langchain": ("BaseTool", "StructuredTool", "LangChainTool"),
    "langgraph": ("BaseTool", "StructuredTool"),
    "crewai": ("BaseTool",),
    "llama_index": ("FunctionTool", "BaseTool"),
    "openai_agents_sdk": ("FunctionTool", "Tool"),
    "autogen": ("Tool",),
    "langroid": ("Tool",),
    "camel": ("Tool",),
    "letta": ("Tool",),
}

# Longer decorator names that hold one of these words are covered by it.
TOOL_DECORATORS = ("tool", "Tool")
NOT_TOOL_DECORATORS = ("mcp.tool", "mcp_server.tool")
MCP_DECORATORS = ("server.tool", "@tool", "mcp.tool")
TOOL_METHODS = ("bind_tools", "with_tools", "add_tool", "register_tool")
FIXTURE_DECORATORS = ("setUp", "tearDown", "setup", "teardown", "pytest.fixture")
MOCK_WORDS = ("mock", "patch", "spy", "stub", "fake", "monkeypatch")
SETUP_NAMES = ("setup", "setup_method", "setup_class", "setupclass")
TEARDOWN_NAMES = ("teardown", "teardown_method", "teardown_class", "teardownclass")


class AgentRule(NamedTuple):
    """A call that makes its function an agent of ``framework``, in modules importing one of ``imports``."""

    framework: str
    imports: tuple[str, ...]
    constructor: bool
    names: tuple[str, ...]
    description: str
    receiver: str | None = None
    fills_tools: bool = False


def _made_by(framework: str) -> str:
    return framework + " agent created via {}"


# Order within a framework decides which call names the agent when several match.
AGENT_RULES = (
    AgentRule("langchain", ("langchain",), False,
              ("create_agent", "create_react_agent", "create_tool_calling_agent", "initialize_agent"),
              _made_by("LangChain"), None, True),
    AgentRule("langchain", ("langchain",), True, ("AgentExecutor",), _made_by("LangChain"), None, True),
    AgentRule("langchain", ("langchain",), False, ("assign",),
              "LangChain agent created via RunnablePassthrough.assign() pattern", "RunnablePassthrough", True),
    AgentRule("langgraph", ("langgraph",), True, ("StateGraph",), _made_by("LangGraph")),
    AgentRule("langgraph", ("langgraph",), False, ("create_react_agent",), _made_by("LangGraph")),
    AgentRule("crewai", ("crewai",), True, ("Agent",), "CrewAI agent created via Agent constructor"),
    AgentRule("autogen", ("autogen", "autogen_agentchat", "autogen_ext"), True,
              ("AssistantAgent", "UserProxyAgent", "ConversableAgent"), _made_by("AutoGen")),
    AgentRule("semantic_kernel", ("semantic_kernel",), True, ("ChatCompletionAgent",),
              "Semantic Kernel agent created via ChatCompletionAgent"),
    AgentRule("llama_index", ("llama_index",), True, ("FunctionAgent", "AgentWorkflow", "ReActAgent"),
              _made_by("LlamaIndex")),
    AgentRule("haystack", ("haystack",), True, ("Agent",), "Haystack agent created via Agent component"),
    AgentRule("metagpt", ("metagpt",), True, ("Role", "ProductManager", "Architect", "Engineer"), _made_by("MetaGPT")),
    AgentRule("swarm", ("swarm",), True, ("Agent",), "OpenAI Swarm agent created via Agent constructor"),
    AgentRule("dspy", ("dspy",), True, ("ReAct",), "DSPy agent created via ReAct"),
    AgentRule("openai_agents_sdk", ("agents",), True, ("Agent",), "OpenAI Agents SDK agent via {}"),
    AgentRule("openai_agents_sdk", ("agents",), False, ("run_sync", "run"), "OpenAI Agents SDK agent via {}"),
    AgentRule("langroid", ("langroid",), True, ("ChatAgent", "ChatAgentConfig"), _made_by("Langroid")),
    AgentRule("camel", ("camel",), True, ("ChatAgent",), "CAMEL agent created via ChatAgent"),
    AgentRule("letta", ("letta",), False, ("create",), "Letta agent created via client.agents.create"),
    AgentRule("claude_agent_sdk", ("anthropic.agents", "claude_agent_sdk"), True, ("Agent",),
              "Claude Agent SDK agent created via Agent constructor", None, True),
)
