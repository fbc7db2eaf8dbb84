"""quillstack.functions"""
