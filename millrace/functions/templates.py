"""Prompt templates."""

from __future__ import annotations

# Prompt wording. ``{name}`` marks a slot; the layout, including
# the indentation of the lines after the first, is part of the text.
ASSEMBLY_BODY = """

        - The assembly code:
        ```Assembly
        {assembly}
        ```

        - The data mapping table:
        ```Json
        {data}
        ```

        The high-level C source code is: """

GRAPH_BODY = """

        - The control flow graph:
        ```Json
        {graph}
        ```

        - The data mapping table:
        ```Json
        {data}
        ```

        The high-level C source code is: """

DRAFT_ASSEMBLY_BODY = """

        - The assembly code: 
        ```Json
        {assembly}
        ```

        - The data mapping table:
        ```Json
        {data}
        ```

        The high-level C source code is: """

# Template name to its opening for a single block and for a graph.
OPENINGS = {
    "plain": (
        "Please understand the following assembly code and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code.",
        "Please understand the following control flow graph and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code.",
    ),
    "with_metadata": (
        "Within {info}, please understand the following assembly code and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code.",
        "Within {info}, please understand the following control flow graph and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code.",
    ),
    "instruct": (
        "You are a professional decompilation assistant. Please understand the following assembly code and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code. Please ensure that the generated C source code is well-structured, syntactically correct, and reflects the accurate logic and data of the assembly code.",
        "You are a professional decompilation assistant. Please understand the following control flow graph and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code. Please ensure that the generated C source code is well-structured, syntactically correct, and reflects the accurate logic and data of the assembly code.",
    ),
    "instruct_with_metadata": (
        "You are a professional decompilation assistant. Within {info}, please understand the following assembly code and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code. Please ensure that the generated C source code is well-structured, syntactically correct, and reflects the accurate logic and data of the assembly code.",
        "You are a professional decompilation assistant. Within {info}, please understand the following control flow graph and data mapping table (defines the correspondence between data labels and their actual values), and perform decompilation into corresponding high-level C source code. Please ensure that the generated C source code is well-structured, syntactically correct, and reflects the accurate logic and data of the assembly code.",
    ),
    "draft": (
        "Please understand the function's logic and data based on the following assembly code and data mapping table (defines the correspondence between data labels and their actual values), and predict the corresponding high-level C source code.",
        "Please understand the function's logic and data based on the following control flow graph and data mapping table (defines the correspondence between data labels and their actual values), and predict the corresponding high-level C source code.",
    ),
}

# Template name to (text for a single block, text for a graph).
TEMPLATES = {
    name: (single + (DRAFT_ASSEMBLY_BODY if name == "draft" else ASSEMBLY_BODY), several + GRAPH_BODY)
    for name, (single, several) in OPENINGS.items()
}

DISASSEMBLY_TEMPLATE = (
    "The assembly code is obtained by disassembling the binary file (compiled by GCC) using objdump, "
    "and its content is represented as a JSON dictionary: \n{assembly}\n\n"
    "- The control flow graph (CFG) information is extracted by IDA from the binary file and is "
    "represented as another JSON dictionary: \n{graph}\n\n"
    "Each 'cfg_block' in 'a list of cfg_blocks' contains: \n"
    "  - 'assemblock': The assembly instructions within the block.\n"
    "  - 'bytecode': The hexadecimal bytecode corresponding to the block. \n"
    "  - 'addr': The tuple of start and end addresses of the instructions.\n\n"
    "The high-level source code is: "
)

DISASSEMBLY_KEYS = (
    "instruction set architecture",
    "bit width",
    "compiler optimization level",
    "assembly code",
)
DISASSEMBLY_GRAPH_KEYS = {
    "a list of cfg_blocks": "nodes",
    "edges between two connected cfg_blocks": "edges",
    "cfg_block count": "nodenum",
}
SLOT_GRAPH_KEYS = {"cfg_blocks": "nodes", "edges": "edges", "cfg_block count": "nodenum"}
SLOT_DATA_KEYS = {"param": "param", ".rodata": ".rodata", ".data": ".data", ".bss": ".bss"}
