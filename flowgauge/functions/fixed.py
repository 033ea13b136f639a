"""Patterns and word lists that results depend on, written as they must match. Patterns are for Python's re;
where Java's syntax differs, the module that uses one says how."""

#: What a simple command does, matched at its program's name: it changes something, checks something, runs code, or looks.
CHANGE = (
    r"(?:(?:pip3?|uv pip|poetry|npm|yarn|pnpm|cargo|go|gem|bundle|apt(?:-get)?|brew)\s+(?:install|add|remove|uninstall|get|update|upgrade)"
    r"|git\s+(?:add|commit|checkout|switch|reset|restore|apply|merge|rebase|mv|rm|push|stash|cherry-pick)"
    r"|mkdir|rm|mv|cp|touch|chmod|chown|ln|patch|sed\s+-i|tee)(?:\s|$)"
)
VALIDATE = (
    r"(?:pytest|py\.test|tox|nox|unittest|doctest|jest|vitest|mocha|ava|karma|rspec"
    r"|phpunit|ctest|ruff|mypy|pyright|flake8|pylint|bandit|eslint|tsc|prettier\s+--check"
    r"|black\s+--check|isort\s+--check|shellcheck|hadolint|golangci-lint|lint-imports"
    r"|go\s+(?:test|vet|build)|cargo\s+(?:test|check|clippy|build)|mvn|gradlew?\s+\S*(?:test|check|build)"
    r"|dotnet\s+(?:test|build)|make\s+(?:test|check|lint|ci)|(?:npm|yarn|pnpm)\s+(?:run\s+)?(?:test|lint|check|build|typecheck)"
    r"|playwright\s+test|cypress\s+run|bazel\s+test|swift\s+test"
    r"|pre-commit\s+run|gh\s+(?:pr\s+checks|run\s+(?:watch|view)))(?:\s|$)"
)
ADHOC_RUN = r"(?:python3?|node|deno|bun|ruby|php)\s+(?:-c(?:\s|$)|-(?:\s|$)|-m\s+\w|[\w./-]+\.(?:py|js|mjs|ts|rb|php)(?:\s|$))"
EXPLORE = (
    r"(?:ls|cat|head|tail|less|more|find|grep|rg|ag|tree|pwd|wc|file|stat|du"
    r"|which|type|echo|env|printenv|git\s+(?:status|log|diff|show|blame|branch|remote|ls-files|grep))(?:\s|$)"
)
#: Words that run the command after them, alone and in pairs.
PREFIXES = "sudo env time nohup exec command nice xargs npx bunx pnpx".split()
RUNNERS = ["uv run", "poetry run", "pipenv run", "pdm run", "hatch run", "rye run", "pnpm exec", "yarn exec", "bundle exec"]

#: What marks a failed and a passed run in its output (multi-line; the second in either case), and what differs from run to run.
FAILED = (
    r"(?:\b\d+\s+(?:failed|failures?|errors?)\b(?<!\b0 failed)(?<!\b0 errors)(?<!\b0 error)"
    r"|^FAILED\b|^FAIL\b|\bFAILED\s+\S+::|^ERROR[:\s]|^E\s{2,}\S"
    r"|Traceback \(most recent call last\)|^\w*Error: |^error(?:\[\w+\])?: "
    r"|\bexit (?:code|status) [1-9]\d*|\bExit code [1-9]\d*|command not found"
    r"|npm ERR!|^\s*[✗✘×] |\bFound \d+ errors?\b(?<!Found 0 errors)|\bTests?:\s+\d+ failed)"
)
PASSED = (
    r"(?:\b\d+\s+passed\b|^OK\b|\bAll checks passed\b|\bSuccess(?:fully)?\b|\bchecks? passed\b"
    r"|\bno issues found\b|\b0 errors?\b|\bTests?:\s+\d+ passed\b|^ok\s|\bBUILD SUCCESSFUL\b"
    r"|\bFinished\b.*\btarget\(s\)|^PASS\b)"
)
NOISE = r"(?:\bin\s+\d+(?:\.\d+)?\s*m?s\b|\d+(?:\.\d+)?s\b|0x[0-9a-f]+|\b\d{4}-\d\d-\d\d[T ][\d:.]+Z?)"

#: Words that carry no content of their own.
STOPWORDS = """
a an the and or but if then else so to of in on at by for with from into onto
is are was were be been being it its this that these those there here i we you
he she they them our my your me us do does did done can could should would will
shall may might must need needs let lets now just also still again only very
what which who whom whose when where why how all any each some more most other
such no not nor too than as up out about over under before after while
make sure first next last think file files use using used
""".split()
#: Words that say how, and not what, beside the stop words.
GENERIC = """
add write create implement change update fix function method class module
code new also instead actually please want like src lib def self none true
false return import from print python elif pass lambda forget drop stop
scratch mind longer rather okay yes yeah thanks thank has have had
""".split()

#: How a sentence begins that turns to something else, and what marks one that gives something up (in either case).
REDIRECT = r"^\W*(?:actually|instead|forget|never\s*mind|scratch\s+that|change\s+of\s+plans?|new\s+task|different\s+task|stop|drop|let'?s\s+switch|switch\s+to|rather)\b"
ABANDON = r"\b(?:forget|drop|never\s*mind|scratch|no\s+longer|don'?t|do\s+not|stop)\b"
#: Where sentences of a prompt end.
SENTENCE = r"(?<=[.!?;\n])\s+|\n+"
