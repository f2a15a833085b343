from .conftest_llm import corpus, docs_of  # noqa: F401
