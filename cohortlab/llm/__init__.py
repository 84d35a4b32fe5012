"""Training-data operators: extraction, deduplication, quality, privacy, tokens.

Nothing outside this subpackage imports it. Python that runs inside tasks works on
Arrow batches (``mapInArrow``) through the byte kernels of ``bytekit``.
"""
