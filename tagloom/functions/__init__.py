"""Column functions: Column in, Column out, all inside whole-stage codegen."""
