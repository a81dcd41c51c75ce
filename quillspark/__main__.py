from quillspark.cli import main

main()
