"""See the README for what each module of this subpackage holds."""
