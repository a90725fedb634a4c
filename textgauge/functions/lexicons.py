"""Word lists and symbol classes of the feature profiles.

Everything here is a fixed value: the features count exactly these words, phrases and symbols,
so changing one changes the meaning of a stored feature.
"""

# Abbreviations spelled out before counting (short list, then the full one).
SHORT_EXPANSIONS = {
    "dfs": "depth first search",
    "bfs": "breadth first search",
    "dp": "dynamic programming",
}
FULL_EXPANSIONS = {
    "dfs": "depth first search",
    "bfs": "breadth first search",
    "dp": "dynamic programming",
    "lca": "lowest common ancestor",
    "mst": "minimum spanning tree",
    "scc": "strongly connected components",
    "gcd": "greatest common divisor",
    "lcm": "least common multiple",
    "bst": "binary search tree",
    "avl": "avl tree",
    "rb": "red black tree",
    "kmp": "knuth morris pratt",
    "bit": "binary indexed tree",
    "fft": "fast fourier transform",
}

# Word-bounded lists of the 15-feature profile.
CORE_WORDS = {
    "graph_algorithms": [
        "graph", "tree", "node", "edge", "path", "dfs", "bfs", "depth first", "breadth first",
    ],
    "dynamic_programming": ["dynamic programming", "dp", "memoization", "optimal substructure"],
    "data_structures": ["heap", "stack", "queue", "hash", "trie", "segment tree"],
    "sorting_searching": ["sort", "binary search", "merge", "quick"],
    "string_processing": ["string", "substring", "character", "palindrome"],
}

# Patterns of the 15-feature profile that need no word boundary.
BASIC_MATH = r"[+\-*/=<>]"
ADVANCED_MATH = "[∑∏∫∂∆√π∞≤≥]"
BIG_O = r"(?i)o\([^)]+\)"
CONSTRAINTS = r"constraint|limit|\p{Nd}+\s*≤.*≤\s*\p{Nd}+"
OPTIMIZATION = "minimum|maximum|optimal|best"
# Sequences of literals with anything between, matched greedily.
MULTIPLE_CASES = [["test", "case"], ["multiple", "test"]]

# The five algorithm tiers of the 30-feature profile, each with its weight.
TIERS = {
    "ultra_hard_score": (5.0, [
        "suffix array", "convex hull", "network flow", "maximum flow", "minimum cut",
        "bipartite matching", "heavy light decomposition", "centroid decomposition",
        "link cut tree", "persistent segment tree", "sqrt decomposition", "mo algorithm",
        "aho corasick", "z algorithm", "manacher",
    ]),
    "hard_score": (4.0, [
        "dynamic programming", "segment tree", "fenwick tree", "binary indexed tree",
        "lowest common ancestor", "strongly connected components", "articulation points",
        "bridges", "tarjan", "kosaraju", "suffix tree", "trie", "kmp algorithm", "rabin karp",
        "rolling hash",
    ]),
    "medium_hard_score": (3.0, [
        "depth first search", "breadth first search", "dijkstra", "bellman ford",
        "floyd warshall", "minimum spanning tree", "kruskal", "prim", "topological sort",
        "binary search tree", "avl tree", "red black tree", "heap", "priority queue",
    ]),
    "medium_score": (2.0, [
        "binary search", "two pointer", "sliding window", "hash table", "hash map", "union find",
        "disjoint set", "merge sort", "quick sort", "counting sort",
    ]),
    "basic_score": (1.0, [
        "linear search", "bubble sort", "selection sort", "insertion sort", "array", "string",
        "stack", "queue", "linked list",
    ]),
}

# Symbol class, patterns with weights, and word lists of the 30-feature profile.
WIDE_MATH = "[∑∏∫∂∆√π∞≤≥≠≈∈∉∪∩⊂⊃∅⊆⊇∧∨¬→↔∀∃]"
MATH_FUNCTIONS = [
    "sin", "cos", "tan", "log", "ln", "exp", "sqrt", "abs", "floor", "ceil", "mod", "gcd", "lcm",
    "factorial", "fibonacci", "prime", "composite",
]
TIME_MENTIONS = [["time", "complexity"], ["running", "time"], ["time", "limit"]]
SPACE_MENTIONS = [["space", "complexity"], ["memory", "limit"], ["space", "limit"]]
CONSTRAINT_MENTIONS = r"constraint|limit|bound|\p{Nd}+\s*≤.*≤\s*\p{Nd}+|1\s*≤.*≤\s*10\^\p{Nd}+"
WIDE_WORDS = {
    "graph_indicators": [
        "graph", "tree", "node", "edge", "vertex", "path", "cycle", "connected", "component",
        "forest", "dag", "directed", "undirected", "weighted", "unweighted",
    ],
    "string_indicators": [
        "string", "substring", "subsequence", "character", "palindrome", "anagram", "pattern",
        "text", "word", "sentence", "lexicographic",
    ],
    "array_indicators": [
        "array", "list", "element", "index", "position", "subarray", "subsequence",
        "permutation", "combination",
    ],
    "number_theory_indicators": [
        "prime", "composite", "divisor", "multiple", "modular", "arithmetic", "geometric",
        "sequence", "series",
    ],
    "geometry_indicators": [
        "point", "line", "circle", "polygon", "triangle", "rectangle", "coordinate", "distance",
        "angle", "area", "perimeter",
    ],
    "optimization_keywords": [
        "minimum", "maximum", "optimal", "best", "least", "most", "minimize", "maximize",
        "efficient", "optimize",
    ],
    "difficulty_easy": [
        "print", "output", "simple", "basic", "count", "sum", "find", "easy", "straightforward",
    ],
    "difficulty_hard": [
        "complex", "advanced", "sophisticated", "difficult", "challenging", "tricky",
        "non.?trivial",
    ],
}
IO_FORMAT = [["input", "format"], ["output", "format"]]
IO_CASES = [["test", "case"], ["multiple", "test"], ["t", "test", "case"]]
IO_SAMPLES = "example|sample"
COMPETITIVE_TERMS = [
    "contest", "competition", "judge", "verdict", "accepted", "wrong.*answer",
    "time.*limit.*exceeded", "memory.*limit.*exceeded",
]

# The 4-feature preview profile.
PREVIEW_SYMBOLS = r"[+\-*/=<>$^∑∏∫∂∆√π∞≤≥≠≈∈∉∪∩⊂⊃∅%&|~!@#()\[\]{}]"
PREVIEW_WORDS = [
    "graph", "dp", "recursion", "tree", "constraint", "query", "algorithm", "optimize",
    "complexity", "binary", "search", "sort", "heap", "stack", "queue", "dynamic", "greedy",
    "backtrack", "dfs", "bfs", "shortest", "path", "minimum", "maximum", "optimal", "efficient",
]
