"""Source-code transforms.

Python goes by its own grammar. JavaScript, TypeScript, Java, Kotlin, Scala, Go, Rust, C and C++ are read lexically:
comments, strings and brackets exactly, declarations by patterns. That misses declarations that macros make, several
declarators of one statement after the first, and bodies without braces (Scala's and Kotlin's expression bodies stay).
A grammar can take the place of :func:`loomtext.operators.code.reading.elements` without touching anything else.
"""
